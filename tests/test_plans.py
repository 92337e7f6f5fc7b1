"""The plans behind the results: what reaches the scan, what moves, and what happens to hot keys."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from crewledger.operators import clients, costing, crew, estimates, invoices, payments, quality, revenue
from crewledger.plans import catalogue, views
from crewledger.schemas import SCHEMAS
from crewledger.sources import bindings
from crewledger.sources.tables import append, load_tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()

# Windows are used only over rows whose number is bounded: one per task, one
# per calendar month, or the rows left by a limit.
BOUNDED_WINDOWS = {name for name in QUERIES if name.startswith("ingest_")} | {
    "assigned_ids", "monthly_chart", "rank_clients", "rank_clients_with_feedback", "payments_ingested_twice", "clients_ranked"} | {
    name for name in QUERIES if name.endswith("_in_order")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    for table, rows in tables.items():
        append(rows, path, table)
    return load_tables(spark, path)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "payment_stream_balances"])
def test_queries_stay_on_the_jvm_and_join_on_keys(name, spark):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in BOUNDED_WINDOWS:
        assert not re.search(r"\bWindow \[", plan)


def test_periods_and_columns_reach_the_scan(stored):
    plan = plan_of(invoices.monthly_revenue(stored, month=3, year=2024).select("Invoice_ID"))
    assert "GreaterThanOrEqual(Invoice_Date,2024-03-01)" in plan
    assert "LessThan(Invoice_Date,2024-04-01)" in plan
    assert "ReadSchema: struct<Invoice_ID:bigint,Client_ID:bigint,Invoice_Date:date>" in plan
    month = plan_of(invoices.vw_payments_this_month(stored, "2024-07-15"))
    assert "GreaterThanOrEqual(Payment_Date,2024-07-01)" in month and "LessThan(Payment_Date,2024-08-01)" in month
    open_set = plan_of(invoices.outstanding_invoices(stored, "2024-07-01"))
    assert "In(Invoice_Status, [Partial,Unpaid])" in open_set
    year = plan_of(costing.job_costing(stored, year=2024))
    assert "GreaterThanOrEqual(Service_Date,2024-01-01)" in year


def test_filter_on_an_employee_passes_below_the_aggregate(stored):
    plan = plan_of(crew.my_clients(stored, 2))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "Service_ID" in line and "Employee_ID" in line]
    assert scans and all("EqualTo(Employee_ID,2)" in line for line in scans)


def test_employee_filter_turns_the_outer_join_into_an_inner_one(stored):
    plan = plan_of(estimates.estimate_employees(stored, employee_id=2))
    assert "LeftOuter" not in plan


def test_aggregates_drop_the_sort_of_a_listing(stored):
    plan = plan_of(invoices.all_invoices(stored).agg(F.sum("Balance_Due")))
    assert "rangepartitioning" not in plan


def test_a_listing_to_be_stored_is_not_sorted(stored):
    for operator in (invoices.all_invoices, clients.vw_client_service_history, costing.job_costing):
        assert "rangepartitioning" in plan_of(operator(stored))
        assert "rangepartitioning" not in plan_of(operator(stored, ordered=False))


def test_top_k_does_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan_of(revenue.top_clients(stored))
    assert "TakeOrderedAndProject" in plan_of(invoices.recent_outstanding(stored, "2024-07-01"))


def test_totals_come_from_a_subquery(stored):
    plan = plan_of(costing.job_costing(stored))
    assert "scalar-subquery" in plan.lower() or "Subquery" in plan
    assert "Window" not in plan


# ── hot keys ─────────────────────────────────────────────────────────────────────────────────

HOT = 7
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of the rows of every large table point at one key; sizes scaled down to match."""
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    path = str(tmp_path_factory.mktemp("skewed"))
    count = 40_000
    third = F.col("id") % 3 == 0
    client = F.when(third, HOT).otherwise(F.pmod(F.xxhash64("id"), F.lit(4000)))
    own = F.col("id")
    columns = {
        "Client": {"Client_Name": F.concat(F.lit("c"), own)},
        "Employee": {"Employee_Name": F.concat(F.lit("e"), own)},
        "Estimate": {"Client_ID": client, "Employee_ID": F.when(~third, F.pmod(own, F.lit(400)))},
        "Contract": {"Estimate_ID": own, "Client_ID": client},
        "Service": {"Client_ID": client, "Contract_ID": F.when(third, HOT).otherwise(own), "Service_Type": F.lit("x")},
        "Invoice": {"Client_ID": client, "Contract_ID": own, "Total_Amount": F.lit(1), "Amount_Paid": F.lit(1)},
        "Payment": {"Contract_ID": client, "Invoice_ID": F.when(third, HOT + 4).otherwise(own),
                    "Payment_Amount": F.lit(2), "Payment_Date": F.lit("2024-01-05")},
        "Service_Employee": {"Employee_ID": F.pmod(own, F.lit(400))},
    }
    rows = {"Client": 4000, "Employee": 400}
    tables = {}
    for table, made in columns.items():
        fields = SCHEMAS[table].fields
        spark.range(0, rows.get(table, count), 1, 16).select([
            (own if i == 0 else made.get(field.name, F.lit(None))).cast(field.dataType).alias(field.name)
            for i, field in enumerate(fields)
        ]).write.parquet(f"{path}/{table}")
        tables[table] = spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")
    yield tables
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("listing", [
    invoices.all_invoices,
    estimates.all_estimates,
    clients.client_service_history,
    clients.vw_client_service_history,
    crew.schedule_workload,
    lambda t: invoices.vw_payments_this_month(t, "2024-01-01"),
    lambda t: quality.check_foreign_key(t["Invoice"], "Client_ID", t["Client"], "Invoice_ID").accepted,
], ids=["invoices", "estimates", "history", "history view", "schedule", "payments", "foreign key"])
def test_a_hot_key_is_split(listing, skewed):
    assert "skew=true" in final_plan(listing(skewed))


def test_hot_contract_reaches_the_revenue_join_as_one_row(skewed):
    plan = final_plan(revenue.revenue_by_service(skewed))
    # Both sides are aggregated below the join, on the map side first.
    join = plan.index("SortMergeJoin")
    below = plan[join:]
    assert "partial_count(1)" in below and "partial_sum(Total_Amount" in below
    row = revenue.revenue_by_service(skewed).first()
    # One invoice of 1 per contract, so revenue equals the number of services.
    assert (row["Total_Services"], row["Total_Revenue"]) == (40_000, 40_000)


def test_hot_contract_with_many_invoices_forms_no_pairs(spark, skewed):
    """A third of all services and a third of all invoices meet: 178 million pairs, never formed."""
    same = skewed["Invoice"].withColumn("Contract_ID", F.when(F.col("Invoice_ID") % 3 == 0, HOT).otherwise(F.col("Contract_ID")))
    row = revenue.vw_revenue_by_service_type(skewed | {"Invoice": same}).first()
    hot = 13_334
    # The hot contract has its own service 7 and invoice 7 besides the redirected thirds.
    pairs = (hot + 1) * (hot + 1) + (40_000 - hot - 1)
    assert (row["Total_Services"], row["Total_Revenue"]) == (pairs, pairs)


def test_rows_without_a_key_are_spread(skewed):
    joined = estimates.all_estimates(skewed)
    plan = final_plan(joined)
    assert "_spread" in plan
    assert joined.filter("Employee_ID IS NULL").count() == 13_334


def test_hot_invoice_is_summed_before_the_join(skewed):
    after = payments.apply_payments(skewed["Invoice"], skewed["Payment"])
    assert "partial_sum(Payment_Amount" in plan_of(after)
    paid = {r["Invoice_ID"]: r["Amount_Paid"] for r in after.filter("Invoice_ID IN (8, 11)").collect()}
    assert paid == {8: 3, 11: 1 + 2 * 13_335}


def test_period_totals_read_the_years_asked_for(spark, tables, tmp_path):
    """Other years hold files that cannot be read; with a period of any year they are needed."""
    path = str(tmp_path)
    rows = tables["Invoice"].filter("year(Invoice_Date) = 2024").limit(3).unionByName(
        tables["Invoice"].limit(2).withColumn("Invoice_Date", F.lit("2019-05-05").cast("date"))).unionByName(
        tables["Invoice"].limit(1).withColumn("Invoice_Date", F.lit(None).cast("date")))
    append(rows, path, "Invoice")
    stored = load_tables(spark, path, names=["Invoice"])["Invoice"]
    kept = spark.createDataFrame([r.asDict() for r in rows.collect()], tables["Invoice"].schema)
    dated = spark.createDataFrame([(5, 2024), (None, 2024), (1, 2031)], "Month int, Year int")
    everything = spark.createDataFrame([(5, None), (None, 2024)], "Month int, Year int")
    for periods in (dated, everything, dated.limit(0)):
        got, wanted = (sorted(map(str, invoices.period_totals(x, periods).collect())) for x in (stored, kept))
        assert got == wanted
    totals = invoices.period_totals(stored, dated)
    assert re.search(r"PartitionFilters: \[[^\]]*isnull\(Stored_Year[^\]]*subquery", plan_of(totals))
    (tmp_path / "Invoice" / "Stored_Year=2019" / "part-broken.parquet").write_bytes(b"not a file of ours")
    broken = load_tables(spark, path, names=["Invoice"])["Invoice"]
    assert invoices.period_totals(broken, dated).count() == 3
    with pytest.raises(Exception, match="(?i)parquet"):
        invoices.period_totals(broken, everything).collect()


def test_totals_of_job_costs_share_the_exchanges_of_the_rows(stored):
    """Service and Job_Costing are read once for the rows and for their totals."""
    jobs = costing.job_costing(stored, ordered=False)
    jobs.collect()
    plan = plan_of(jobs).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan or "ReusedSubquery" in plan or plan.count("/Job_Costing]") <= 2


def test_history_reads_every_table_twice_at_most(stored):
    plan = plan_of(clients.vw_client_service_history(stored, ordered=False))
    present = [line for line in plan.splitlines() if "bit_or" in line and "partial_bit_or" not in line]
    assert present and len(set(re.sub(r"#\d+L?|^[^A-Z]*", "", line) for line in present)) == 1
    for level in ("left_anti", "LeftAnti"):
        assert level not in plan


def test_registered_views_carry_no_sort(spark, tables):
    names = views.register_views(spark, tables, "2024-07-15")
    assert names == views.NAMES and len(names) == 13
    for name in names:
        assert "rangepartitioning" not in plan_of(spark.sql(f"SELECT * FROM {name}")), name


def test_positions_do_not_meet_in_one_task(spark, tables):
    """Positions over many rows: no window over all of them, only over the tasks."""
    ranked = clients.rank_clients(tables, limit=1_000_000)
    plan = plan_of(ranked)
    assert "_task" in plan and "windowspecdefinition(Total_Collected" not in plan
    short, long = clients.rank_clients(tables, 2), ranked.filter("Rank <= 2")
    assert short.select(long.columns).collect() == long.orderBy("Rank").collect()
    assert [r.Rank for r in clients.rank_clients(tables, 1_000_000, client_id=2, keep_global_rank=False).collect()] == [1]


def test_history_entries_are_linear(spark, tables):
    """A contract with 30 services and 40 invoices has 70 entries, not 1200 rows."""
    one = tables["Service"].filter("Contract_ID IS NOT NULL").limit(1).drop("Service_ID").crossJoin(spark.range(100, 130).withColumnRenamed("id", "Service_ID"))
    contract = one.first()["Contract_ID"]
    bill = tables["Invoice"].limit(1).drop("Invoice_ID", "Contract_ID").crossJoin(
        spark.range(100, 140).withColumnRenamed("id", "Invoice_ID")).withColumn("Contract_ID", F.lit(contract))
    few = tables | {"Service": one.select(tables["Service"].columns), "Invoice": bill.select(tables["Invoice"].columns), "Payment": tables["Payment"].limit(0)}
    assert clients.client_service_history(few).count() == 1200
    assert clients.client_history_entries(few).count() == 70


# ── disk ─────────────────────────────────────────────────────────────────────────────────────


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.splitlines() if f.endswith(".data") and "shuffle_" in f}


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Tables of the driver's schema with unknown, repeated and null keys."""
    path = str(tmp_path_factory.mktemp("star"))
    day = "timestamp_ntz'1997-03-04 00:00:00'"
    rows = {
        "region": "SELECT id, 'R' || id FROM range(2)",
        "nation": "SELECT id, 'N' || id, id % 2 FROM range(3)",
        "customer": "SELECT nullif(id, 9), 'C' || id % 7, id % 4, 10.5, 'MACHINERY' FROM range(12) UNION ALL SELECT 3, 'again', 1, 1.0, 'X'",
        "supplier": "SELECT id, 'S' || id, id % 3, id * 1000.0 FROM range(8)",
        "part": "SELECT nullif(id, 5), 'P' || id, 'B', 'T' || id % 3, 1, 1.0 FROM range(20) UNION ALL SELECT 4, 'again', 'B', 'T9', 1, 1.0",
        "orders": f"""SELECT nullif(id, 8), id % 14, element_at(array('F', 'P', 'O'), int(id % 3 + 1)), id * 10.0, {day} + make_interval(0, id % 5),
            if(id % 4 = 0, '1-URGENT', '4-NOT SPECIFIED') FROM range(60) UNION ALL SELECT 6, 2, 'O', 5.0, {day}, '1-URGENT'""",
        "lineitem": f"""SELECT nullif(id % 70, 33), nullif(id % 23, 11), id % 9, int(id % 3), 1.0, id * 1.5, 0.1, 0.1, 'N', 'O',
            nullif({day} + make_interval(0, 0, 0, int(id % 90)), {day} + make_interval(0, 0, 0, 7)) FROM range(400)""",
        "events": "SELECT id, timestamp_ntz'2024-01-10 00:00:00' + make_interval(0, id % 2), id, if(id % 3 = 0, 'purchase', 'view'), id * 1.0, '{}' FROM range(90)",
        "documents": "SELECT id, 'text', if(id % 3 = 0, 'de', 'en'), 's', id FROM range(40)",
    }
    for table, sql in rows.items():
        wanted = spark.createDataFrame([], bindings.STAR[table]).schema
        made = spark.sql(sql).toDF(*wanted.names)
        made.select([F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(f"{path}/{table}.parquet")
    return path


def test_views_are_counted_one_after_another_and_leave_no_shuffle_files(spark, star):
    """The disk holds the shuffles of one view at a time, not those of all thirteen until the query has ended."""
    plain = views.views(bindings.bound_tables(spark, star), catalogue.VIEW_DAY)
    expected = {name: plain[name]().count() for name in views.NAMES}
    assert min(expected.values()) > 0
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    got = {r["View_Name"]: r["Row_Count"] for r in QUERIES["views_by_name"](spark, star).collect()}
    assert got == expected
    for _ in range(100):  # files go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(setting, "false") == (was or "false")


@pytest.fixture
def no_broadcasts(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL if "Broadcast" in key}
    for key in before:
        spark.conf.set(key, "-1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_lines_move_once_for_their_order_and_its_customer(spark, star, no_broadcasts):
    joins = [line for line in plan_of(bindings.services(spark, star)).splitlines() if "SortMergeJoin" in line]
    assert "[l_orderkey" in joins[0] and "[partkey" in joins[1] and "[o_custkey" in joins[2]


def test_months_move_once_by_all_their_keys(tables, no_broadcasts):
    """Services meet the sums of their contract unreduced, unless an invoice is to count once per group."""
    def moves(**options) -> int:
        return len(re.findall(r"Exchange hashpartitioning\([^)]*Service_Type", plan_of(
            revenue.vw_monthly_revenue_report(tables, ordered=False, **options))))

    assert (moves(), moves(dedupe_invoices=True)) == (1, 2)
