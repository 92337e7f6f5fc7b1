"""Readers, writers, the payment stream, and small expressions."""

from __future__ import annotations

import datetime
import json
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from crewledger.functions import dates, status, text
from crewledger.operators import costing, estimates, invoices
from crewledger.operators.filters import apply_filters, equals
from crewledger.operators.payments import apply_payments
from crewledger.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, schema_of
from crewledger.session import shared_folder
from crewledger.sources.tables import (
    STORED_YEAR, append, jdbc_options, load_tables, read_table, scan_years, with_virtual, write_json,
)
from crewledger.streaming import payments as payment_stream
from crewledger.streaming.payments import current_balances, payment_log_writer, read_log
from tests.fixture import as_dicts, column


def test_schema_declares_eleven_tables_and_eighteen_references():
    assert len(SCHEMAS) == 11
    assert len(FOREIGN_KEYS) == 18
    assert PRIMARY_KEYS["Service_Employee"] == ["Service_ID", "Employee_ID"]
    with pytest.raises(ValueError, match="unknown table"):
        schema_of("Nothing")


def test_round_trip(spark, tables, tmp_path):
    path = str(tmp_path)
    for table, rows in tables.items():
        append(rows, path, table)
    back = load_tables(spark, path)
    for table, rows in tables.items():
        key = PRIMARY_KEYS[table]
        assert back[table].select(rows.columns).orderBy(key).collect() == rows.orderBy(key).collect()
    of_2023 = scan_years(spark, path, "Invoice", 2023, 2023)
    assert sorted(column(of_2023, "Invoice_ID")) == [5, 6]
    plan = of_2023._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({STORED_YEAR}" in plan


def test_reports_of_a_period_list_its_year_only(spark, tables, tmp_path):
    path = str(tmp_path)
    for table, rows in tables.items():
        append(rows, path, table)
    stored = load_tables(spark, path, stored_years=True)
    reports = {
        "estimates": lambda t: estimates.estimate_employees(t, year=2024),
        "invoices": lambda t: invoices.monthly_revenue(t, month=3, year=2024),
        "costs": lambda t: costing.job_costing(t, year=2024),
        "payments": lambda t: invoices.vw_payments_this_month(t, "2024-03-20"),
    }
    for name, report in reports.items():
        pruned = report(stored)
        assert sorted(map(str, pruned.collect())) == sorted(map(str, report(tables).collect())), name
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[coalesce\(\({STORED_YEAR}#\d+ = 2024\), true\)\]", plan), name
    assert sorted(invoices.monthly_revenue(stored).columns) == sorted(invoices.monthly_revenue(tables).columns)


def test_files_outside_year_folders_are_read(spark, tables, tmp_path):
    tables["Invoice"].write.parquet(str(tmp_path / "Invoice"))
    tables["Client"].write.parquet(str(tmp_path / "Client"))
    stored = load_tables(spark, str(tmp_path), names=["Invoice", "Client"], stored_years=True)
    found, wanted = (column(invoices.monthly_revenue(t, year=2024), "Invoice_ID") for t in (stored, tables))
    assert found == wanted and found


def test_csv_and_json(spark, tables, tmp_path):
    tables["Invoice"].write.option("header", True).csv(str(tmp_path / "Invoice"))
    rows = read_table(spark, str(tmp_path), "Invoice", "csv")
    assert rows.orderBy("Invoice_ID").collect() == tables["Invoice"].orderBy("Invoice_ID").collect()
    write_json(tables["Referral"].coalesce(1).orderBy("Referral_ID"), str(tmp_path / "out"))
    lines = [json.loads(line) for file in (tmp_path / "out").glob("*.json") for line in file.read_text().splitlines()]
    assert list(lines[1]) == SCHEMAS["Referral"].names
    assert (lines[1]["Referrer_ID"], lines[1]["Referral_Date"]) == (None, "2024-02-01")


def test_jdbc_reads_in_parallel_by_key():
    options = jdbc_options("jdbc:x", "Invoice", 1, 1000, 8)
    assert (options["partitionColumn"], options["numPartitions"], options["upperBound"]) == ("Invoice_ID", "8", "1000")


def test_virtual_columns(tables):
    days = {r["Invoice_ID"]: r["Days_Outstanding"] for r in with_virtual(tables["Invoice"], "2024-07-01").collect()}
    assert (days[1], days[10], days[9]) == (0, -31, None)
    assert column(with_virtual(tables["Job_Costing"]), "Variance") == [D(-300), D(10), D(0), D("10.10")]


# ── stream ───────────────────────────────────────────────────────────────────────────────────


def run_stream(spark, source, log, checkpoint):
    stream = spark.readStream.schema(schema_of("Payment")).option("maxFilesPerTrigger", 1).parquet(source)
    query = payment_log_writer(stream, log, checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def balances(df):
    return {r["Invoice_ID"]: (r["Amount_Paid"], r["Invoice_Status"]) for r in df.collect()}


def test_stream_equals_batch_through_replays_and_restarts(spark, tables, tmp_path):
    source, log, checkpoint = (str(tmp_path / name) for name in ("in", "log", "checkpoint"))
    sent = tables["Payment"].filter("Invoice_ID IS NULL OR Invoice_ID <> 5")
    expected = balances(apply_payments(tables["Invoice"], sent))
    sent.filter("Payment_ID <= 2").coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, log, checkpoint)
    # The first two again, within one file and in a later one, then a late payment.
    again = sent.filter("Payment_ID <= 2")
    again.unionByName(again).coalesce(1).write.mode("append").parquet(source)
    sent.filter("Payment_ID > 2").coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, log, checkpoint)
    run_stream(spark, source, log, checkpoint)
    stored = read_log(spark, log)
    assert sorted(column(stored, "Payment_ID")) == [1, 2, 3, 5]
    assert balances(current_balances(tables["Invoice"], stored)) == expected


def test_lost_checkpoint_stores_nothing_twice(spark, tables, tmp_path):
    """Everything is sent again under a new checkpoint, whose batches have the old numbers and other rows."""
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for _, rows in sorted(((n, tables["Payment"].filter(F.col("Payment_ID") % 2 == n)) for n in (0, 1)), key=lambda x: x[0]):
        rows.coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, log, str(tmp_path / "one"))
    tables["Payment"].withColumn("Payment_ID", F.col("Payment_ID") + 100).coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, log, str(tmp_path / "two"))
    sent = tables["Payment"].unionByName(tables["Payment"].withColumn("Payment_ID", F.col("Payment_ID") + 100))
    assert sorted(column(read_log(spark, log), "Payment_ID")) == sorted(column(sent, "Payment_ID"))
    assert balances(current_balances(tables["Invoice"], read_log(spark, log))) == balances(apply_payments(tables["Invoice"], sent))


def test_batch_broken_off_halfway_is_replaced(spark, tables, tmp_path):
    """A batch whose first attempt wrote one of its two ranges and a wrong row."""
    log = str(tmp_path / "log")
    rows = tables["Payment"].withColumn("Payment_ID", F.col("Payment_ID") * 700_000)
    payment_stream.open_log(spark, log)
    payment_stream.append_payments(rows.filter("Payment_ID < 1000000").withColumn("Payment_Amount", F.col("Payment_Amount") + 1), log, "a-7")
    payment_stream.append_payments(rows, log, "a-7")
    payment_stream.append_payments(rows, log, "a-7")
    payment_stream.append_payments(rows, log, "a-8")
    assert sorted(map(tuple, read_log(spark, log).collect())) == sorted(map(tuple, rows.collect()))


def test_payments_without_an_id_are_left_out(spark, tables, tmp_path):
    log = str(tmp_path / "log")
    payment_stream.open_log(spark, log)
    payment_stream.append_payments(tables["Payment"].withColumn("Payment_ID", F.lit(None).cast("long")), log, "a-0")
    assert read_log(spark, log).count() == 0


def test_batch_reads_its_ranges_only(spark, tables, tmp_path):
    log = str(tmp_path / "log")
    payment_stream.open_log(spark, log)
    rows = tables["Payment"].crossJoin(spark.range(5).select(F.col("id").alias("n"))).withColumn(
        "Payment_ID", F.col("Payment_ID") + F.col("n") * 1_000_000).drop("n")
    payment_stream.append_payments(rows, log, "a-0")
    assert payment_stream.touched_ranges(rows.withColumn("Id_Range", payment_stream.id_range())) == [0, 1, 2, 3, 4]
    known = payment_stream.known_ids(spark, log, [1, 3], "a-1")
    assert {r["Payment_ID"] // 1_000_000 for r in known.collect()} == {1, 3}
    plan = known._jdf.queryExecution().executedPlan()
    assert re.search(r"PartitionFilters: \[[^\]]*Id_Range#\d+L IN \(1,3\)", plan.toString())
    files = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
    assert files and all(re.search("Id_Range=[13]/", f) for f in files)


def test_shared_folder_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")


# ── expressions ──────────────────────────────────────────────────────────────────────────────


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_calendar(spark):
    assert dates.period_bounds(2024, 12) == (datetime.date(2024, 12, 1), datetime.date(2025, 1, 1))
    assert dates.period_bounds(2024) == (datetime.date(2024, 1, 1), datetime.date(2025, 1, 1))
    assert value(spark, dates.month_name(F.lit(2))) == "February"
    assert value(spark, dates.month_name(F.lit(13))) is None
    assert value(spark, dates.as_of_date()) == value(spark, F.current_date())
    due = dates.default_due_date(F.lit(None).cast("date"), F.lit("2024-02-20").cast("date"))
    assert value(spark, due) == datetime.date(2024, 3, 6)


@pytest.mark.parametrize("total, paid, new, settled", [
    (100, 0, "Unpaid", "Unpaid"), (100, 99, "Partial", "Partial"), (100, 100, "Paid", "Paid"),
    (100, 101, "Paid", "Paid"), (0, 0, "Unpaid", "Paid"), (100, -5, "Unpaid", "Unpaid")])
def test_invoice_status(spark, total, paid, new, settled):
    assert value(spark, status.new_invoice_status(F.lit(total), F.lit(paid))) == new
    assert value(spark, status.settled_invoice_status(F.lit(total), F.lit(paid))) == settled


def test_status_of_nothing(spark):
    nothing = F.lit(None).cast("int")
    assert value(spark, status.aging_bucket(nothing)) == "60+ Days"
    assert value(spark, status.aging_bucket(nothing, "long")) == "Over 90 Days"
    assert value(spark, status.budget_status(nothing)) == "On Budget"
    assert value(spark, status.schedule_status(F.lit(None).cast("date"), dates.as_of_date("2024-01-01"))) == "Upcoming"


def test_text(spark):
    assert value(spark, text.stars(F.lit(3))) == "⭐⭐⭐"
    assert value(spark, text.stars(F.lit(None).cast("int"))) == ""
    assert value(spark, text.blank_to_null(F.lit("  "))) is None
    assert value(spark, text.label_or(F.lit(""), "No Role")) == "No Role"


def test_open_and_typed_filters(spark, tables):
    assert apply_filters(tables["Client"], {"Client_ID": "", "Client_Name": None}).count() == 5
    assert column(apply_filters(tables["Client"], {"Client_ID": "2"}), "Client_Name") == ["Kim Field"]
    assert apply_filters(tables["Client"], {"Client_ID": "2x"}).count() == 0
    assert tables["Estimate"].filter(equals(tables["Estimate"], "Estimate_Date", "2024-02-29")).count() == 1
