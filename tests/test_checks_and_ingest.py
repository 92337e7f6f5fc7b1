"""Data-quality checks, ingest rules, id assignment and payments."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from crewledger.operators import ingest, order, payments, quality
from crewledger.schemas import SCHEMAS
from crewledger.sources.tables import append, load_tables
from tests.fixture import as_dicts, column

DAY = "2024-07-01"


def reasons(rejects) -> dict:
    return {r["submission_id"]: r["reason"] for r in rejects.collect()}


def forms(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, f"submission_id long, {schema}")


# ── checks ───────────────────────────────────────────────────────────────────────────────────


def test_foreign_keys_of_a_stored_table(tables):
    checked = quality.check_foreign_keys(tables, "Client_Feedback")
    assert sorted(column(checked.accepted, "Feedback_ID")) == [1, 2, 3]
    assert [(r["Feedback_ID"], r["reason"]) for r in checked.rejects.collect()] == [(4, "Service_ID is unknown")]
    assert column(quality.check_foreign_keys(tables, "Referral").rejects, "Referral_ID") == [3]
    for table in ("Estimate", "Contract", "Service", "Service_Employee", "Invoice", "Payment", "Job_Costing"):
        assert quality.orphan_counts(tables, table).count() == 0


def test_required_counts_blank_as_missing(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "  ", 1), (3, None, None)], "id long, name string, n int")
    checked = quality.check_required(rows, ["name", "n"])
    assert column(checked.accepted, "id") == [1]
    assert [(r["id"], r["reason"]) for r in checked.rejects.collect()] == [
        (2, "name is required"), (3, "name is required")]


def test_sizes(spark):
    rows = spark.createDataFrame(
        [(1, "x" * 100, "99999999.99"), (2, "x" * 101, "1"), (3, "ok", "100000000"), (4, "ok", "abc"), (5, None, None)],
        "Client_ID long, Client_Name string, Pricing string")
    assert column(quality.check_sizes(rows.select("Client_ID", "Client_Name"), "Client").rejects, "Client_ID") == [2]
    assert column(quality.check_sizes(rows.select("Client_ID", "Pricing"), "Contract").rejects, "Client_ID") == [3, 4]


def test_values(spark):
    rows = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "Rating int")
    assert column(quality.check_values(rows, "Client_Feedback").rejects, "Rating") == [0, 6]
    status = spark.createDataFrame([("Pending",), ("Gone",), (None,)], "Status string")
    assert column(quality.check_values(status, "Referral").rejects, "Status") == ["Gone"]


def test_unique(tables, spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 1)], "Service_ID long, Employee_ID long")
    checked = quality.check_unique(rows, ["Service_ID", "Employee_ID"])
    assert checked.accepted.count() == 2
    assert [tuple(r) for r in checked.rejects.collect()] == [
        (1, 1, "Service_ID, Employee_ID is not unique")] * 2
    assert quality.duplicate_keys(tables["Invoice"], ["Invoice_ID"]).count() == 0


def test_one_per_key_is_the_least_row(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 9), (2, None, 3)], "id long, t string, n int")
    kept = {tuple(r) for r in quality.one_per_key(rows, ["id"]).collect()}
    assert kept == {(1, "a", 9), (2, None, 3)}


def test_defaults(spark):
    rows = spark.createDataFrame([(1, None), (2, "Paid")], "Invoice_ID long, Invoice_Status string")
    filled = as_dicts(quality.fill_defaults(rows, "Invoice"))
    assert filled == [
        {"Invoice_ID": 1, "Invoice_Status": "Unpaid", "Amount_Paid": D("0.00")},
        {"Invoice_ID": 2, "Invoice_Status": "Paid", "Amount_Paid": D("0.00")}]


# ── ids ──────────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("partitions, level", [(1, 1024), (13, 1024), (40, 8), (7, 1)])
def test_ids_are_consecutive_and_repeatable(spark, tables, monkeypatch, partitions, level):
    """Over one task and many, with groups of tasks of every size."""
    monkeypatch.setattr(order, "TASKS", level)
    rows = spark.range(5000).select((F.col("id") * 31).alias("submission_id")).repartition(partitions)
    numbered = ingest.assign_ids(rows.filter("submission_id % 2 = 1 or submission_id < 90000"), "Client_ID", tables["Client"])
    first = {r["submission_id"]: r["Client_ID"] for r in numbered.collect()}
    assert sorted(first.values()) == list(range(6, 6 + len(first))) and len(first) > 2500
    assert {r["submission_id"]: r["Client_ID"] for r in numbered.orderBy("submission_id").collect()} == first


def test_ids_of_an_empty_table_start_at_one(spark, tables):
    numbered = ingest.assign_ids(spark.range(3).withColumnRenamed("id", "submission_id"), "Client_ID", tables["Client"].limit(0))
    assert sorted(column(numbered, "Client_ID")) == [1, 2, 3]


def test_batch_is_evaluated_once_for_rows_of_two_tables(spark, tables):
    """An accumulator counts how often a submission passes."""
    passed = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda name: passed.add(1) or name, "string").asNondeterministic()
    batch = forms(spark, "client_name string, property_address string, service_description string", [(n, f"C{n}", "Road", "Mow") for n in range(9)])
    done = ingest.ingest_estimate_requests(batch.withColumn("client_name", counted("client_name")), tables, DAY).settled()
    assert [done.rows[t].count() for t in ("Client", "Estimate")] == [9, 9] and done.rejects.count() == 0
    assert passed.value == 9


def test_batch_and_parents_are_read_once_for_their_keys(spark, tables, tmp_path):
    """Two scans of the batch, for keys and for rows, and one of a parent that two columns refer to."""
    path = str(tmp_path)
    append(tables["Client"], path, "Client")
    append(tables["Referral"], path, "Referral")
    stored = load_tables(spark, path, names=["Client", "Referral"])
    flagged = quality.flag_unknown_keys(stored["Referral"], {"Referrer_ID": "Client", "Referee_ID": "Client"}, stored, "Referral_ID")
    assert flagged.count() == tables["Referral"].count()
    flagged.collect()
    plan = flagged._jdf.queryExecution().executedPlan()
    text = re.split("== Initial Plan ==", plan.toString())[0]
    scans = re.findall(r"FileScan parquet \S*\[([^\]]*)\]", text)
    assert sum("Referral_ID" in s for s in scans) == 1 and len([s for s in scans if "Referr" in s or "Referee" in s]) <= 3


def test_unknown_keys_of_several_parents(spark, tables):
    rows = spark.createDataFrame([(1, 1, 1), (2, 99, 1), (3, 1, 99), (4, None, None), (5, 99, 99), (6, 99, 1)], "id long, Client_ID long, Employee_ID long")
    references = {"Client_ID": "Client", "Employee_ID": "Employee"}
    assert {r.key: r.missing for r in quality.unknown_keys(rows, references, tables).collect()} == {99: 3}
    flagged = quality.flag_unknown_keys(rows, references, tables, "id")
    assert flagged.columns == ["id", "Client_ID", "Employee_ID", "reason"]
    assert {r.id: r.reason for r in flagged.collect()} == {
        1: None, 2: "Client_ID is unknown", 3: "Employee_ID is unknown", 4: None, 5: "Client_ID is unknown", 6: "Client_ID is unknown"}


def test_payments_sent_twice_are_stored_once(spark, tables, tmp_path):
    path = str(tmp_path)
    for table, rows in tables.items():
        append(rows, path, table)
    batch = forms(spark, "contract_id long, invoice_id string, payment_amount string", [(1, 1, "1", "350"), (2, 1, None, "5"), (3, None, "1", "5")])
    for again in (batch, batch, batch.unionByName(forms(spark, "contract_id long, invoice_id string, payment_amount string", [(9, 1, "1", "7")]))):
        done = ingest.ingest_once(ingest.ingest_payments, again, load_tables(spark, path), path, "Payment")
    assert reasons(done.rejects) == {3: "Contract_ID is required"}
    stored = load_tables(spark, path)["Payment"]
    new = stored.filter("Payment_ID > 6")
    assert sorted(column(new, "Payment_Amount")) == [D(5), D(7), D(350)] and sorted(column(new, "Payment_ID")) == [7, 8, 9]


def test_form_of_two_tables_goes_on_after_a_crash(spark, tables, tmp_path):
    """The clients were stored, the estimates were not; other clients came in between."""
    path = str(tmp_path)
    for table, rows in tables.items():
        append(rows, path, table)
    schema = "client_name string, property_address string, service_description string"
    batch = forms(spark, schema, [(n, f"C{n}", "Road", "Mow") for n in range(6)])
    first = ingest.ingest_estimate_requests(batch, load_tables(spark, path), DAY).settled()
    append(first.rows["Client"], path, "Client")
    ingest.ingest_once(ingest.ingest_clients, forms(spark, "client_name string", [(100, "Between")]), load_tables(spark, path), path, "Client")
    for _ in range(2):
        ingest.ingest_once(ingest.ingest_estimate_requests, batch, load_tables(spark, path), path, "Estimate", as_of=DAY)
    after = load_tables(spark, path)
    assert sorted(column(after["Client"], "Client_ID")) == list(range(1, 13))
    names = after["Estimate"].filter(f"Estimate_ID > {max(column(tables['Estimate'], 'Estimate_ID'))}").join(after["Client"], "Client_ID")
    assert sorted(column(names, "Client_Name")) == [f"C{n}" for n in range(6)]


def test_rules_of_the_form_pages(spark, tables):
    done = ingest.ingest_payments(forms(spark, "contract_id long, invoice_id string, payment_amount string", [
        (1, 1, "1", "-50"), (2, 1, None, "5"), (3, 1, "1", "0"), (4, 1, "1", "5")]), tables, strict=True)
    assert reasons(done.rejects) == {1: "Payment_Amount is not positive", 2: "Invoice_ID is required", 3: "Payment_Amount is not positive"}
    done = ingest.ingest_invoices(forms(spark, "contract_id long, client_id long, invoice_date string, due_date string, total_amount string", [
        (1, 1, 1, "2024-05-01", "2024-05-09", "-5.00"), (2, 1, 1, "", "2024-05-09", "5"), (3, 1, 1, "2024-05-01", None, "5"),
        (4, 1, 1, "2024-05-01", "2024-05-09", None), (5, 1, 1, "2024-05-01", "2024-05-09", "5")]), tables, strict=True)
    assert reasons(done.rejects) == {1: "Total_Amount is not positive", 2: "Invoice_Date is required", 3: "Due_Date is required",
                                     4: "Total_Amount is not positive"}
    contract = "estimate_id long, client_id long, pricing string, start_date string, end_date string, service_scope string"
    batch = forms(spark, contract, [(1, 1, 1, "5", None, "2024-05-01", "x"), (2, 1, 1, "5", "2024-05-01", " ", "x"),
                                    (3, 1, 1, "5", "2024-05-01", "2024-05-01", " "), (4, 1, 1, "-1", "2024-05-01", "2024-05-01", "x")])
    wanted = {1: "Contract_StartDate is required", 2: "Contract_EndDate is required", 4: "Pricing is not positive"}
    assert reasons(ingest.ingest_contracts(batch, tables, strict=True).rejects) == wanted
    assert reasons(ingest.ingest_contracts(batch, tables, strict=True, with_scope=True).rejects) == wanted | {3: "Service_Scope is required"}
    estimate = "client_id long, property_address string, service_description string, estimated_cost string, estimated_labor_hours string, estimate_date string"
    batch = forms(spark, estimate, [(1, 1, "", "d", "5", "1", "2024-05-01"), (2, 1, "a", None, "5", "1", "2024-05-01"), (3, 1, "a", "d", "", "1", "2024-05-01"),
                                    (4, 1, "a", "d", "5", "-1", "2024-05-01"), (5, 1, "a", "d", "5", "1", None), (6, 1, "a", "d", "5", "1", "2024-05-01")])
    assert reasons(ingest.ingest_estimates(batch, tables, strict=True).rejects) == {
        1: "Property_Address is required", 2: "Service_Description is required", 3: "Estimated_Cost is not positive",
        4: "Estimated_Labor_Hours is not positive", 5: "Estimate_Date is required"}
    batch = forms(spark, "service_id string, total_actual_cost string, total_estimated_cost string", [(1, "1", "0", "5"), (2, "1", "5", ""), (3, "1", "5", "5")])
    assert reasons(ingest.ingest_job_costing(batch, tables, strict=True).rejects) == {
        1: "Total_Actual_Cost is not positive", 2: "Total_Estimated_Cost is not positive"}


# ── forms ────────────────────────────────────────────────────────────────────────────────────


def test_feedback(spark, tables):
    done = ingest.ingest_feedback(forms(spark, "client_id string, service_id string, rating string", [
        (1, "1", "", "5"), (2, "", "1", "5"), (3, "44", "1", "5"), (4, "1", "99", "5"), (5, "1", "1", "6"),
        (6, "one", "1", "5"), (7, "2", "5", None)]), tables, DAY)
    rows = {r["submission_id"]: r for r in done.rows["Client_Feedback"].collect()}
    assert set(rows) == {1, 7}
    assert sorted(r["Feedback_ID"] for r in rows.values()) == [5, 6]
    assert (rows[1]["Service_ID"], rows[1]["Comments"], rows[1]["Feedback_Date"]) == (None, "", datetime.date(2024, 7, 1))
    assert reasons(done.rejects) == {
        2: "Client_ID is required", 3: "Client_ID is unknown", 4: "Service_ID is unknown",
        5: "Rating is not in 1..5", 6: "Client_ID is not a bigint"}
    assert done.rows["Client_Feedback"].select(SCHEMAS["Client_Feedback"].names).schema.names == SCHEMAS["Client_Feedback"].names


def test_estimate_request_makes_a_client_and_its_estimate(spark, tables):
    done = ingest.ingest_estimate_requests(forms(
        spark, "client_name string, client_phone string, property_address string, service_description string,"
               " estimated_cost string", [
            (1, " New One ", " ", "Road 1", "Mow", None), (2, "  ", "1", "Road 2", "Mow", "5"),
            (3, "Third", "3", "Road 3", "Dig", "12.50"), (4, "Fourth", "4", "", "Dig", "1"),
            (5, "Fifth", "5", "Road 5", "Dig", "much")]), tables, DAY).settled()
    people = {r["submission_id"]: r for r in done.rows["Client"].collect()}
    plans = {r["submission_id"]: r for r in done.rows["Estimate"].collect()}
    assert set(people) == set(plans) == {1, 3}
    assert {r["Client_ID"] for r in people.values()} == {6, 7}
    assert {r["Estimate_ID"] for r in plans.values()} == {8, 9}
    for number in people:
        assert people[number]["Client_ID"] == plans[number]["Client_ID"]
    assert (people[1]["Client_Name"], people[1]["Client_Phone"]) == ("New One", None)
    assert (plans[1]["Estimated_Cost"], plans[3]["Estimated_Cost"], plans[1]["Employee_ID"]) == (D(0), D("12.50"), None)
    assert reasons(done.rejects) == {
        2: "Client_Name is required", 4: "Property_Address is required",
        5: "Estimated_Cost does not fit decimal(10,2)"}


def test_clients_and_employees(spark, tables):
    done = ingest.ingest_clients(forms(spark, "client_name string, client_phone string", [
        (1, "Una", "1" * 21), (2, "Una", "1")]), tables)
    assert column(done.rows["Client"], "Client_ID") == [6]
    assert reasons(done.rejects) == {1: "Client_Phone is longer than 20"}
    hired = ingest.ingest_employees(forms(spark, "employee_name string, employee_role string, employee_email string", [
        (1, " Ivo ", "Mower", ""), (2, "", "Mower", ""), (3, "Eve", " ", "")]), tables)
    assert [tuple(r)[1:] for r in hired.rows["Employee"].collect()] == [(4, "Ivo", "Mower", None, None, 1)]
    assert reasons(hired.rejects) == {2: "Employee_Name is required", 3: "Employee_Role is required"}


def test_contracts(spark, tables):
    done = ingest.ingest_contracts(forms(spark, "estimate_id string, client_id long, start_date string, pricing string", [
        (1, "7", 3, "2024-05-01", "10"), (2, None, 3, None, "10"), (3, "70", 3, None, "10"), (4, "7", 30, None, "10"),
        (5, "7", 3, None, "0"), (6, "7", 3, "soon", "10")]), tables)
    assert column(done.rows["Contract"], "Contract_StartDate") == [datetime.date(2024, 5, 1)]
    assert reasons(done.rejects) == {
        2: "Estimate_ID is required", 3: "Estimate_ID is unknown", 4: "Client_ID is unknown",
        5: "Pricing is not positive", 6: "Contract_StartDate is not a date"}


def test_estimates_with_and_without_costs(spark, tables):
    batch = forms(
        spark, "client_id long, employee_id string, estimated_cost string, service_id string, total_actual_cost string,"
               " total_estimated_cost string, estimate_date string", [
            (1, 1, "", "100", None, None, None, "2024-05-01"),
            (2, 1, "2", "100", "4", "90.5", "0", "2024-05-01"),
            (3, 1, "2", None, "4", "90", "80", None),
            (4, 1, "2", "100", "99", "90", None, None),
            (5, 1, "9", "100", None, None, None, None),
            (6, 1, None, "100", "99", "0", None, None)])
    done = ingest.ingest_estimates(batch, tables)
    assert sorted(column(done.rows["Estimate"], "submission_id")) == [1, 2, 3, 6]
    costs = {r["submission_id"]: r for r in done.rows["Job_Costing"].collect()}
    assert set(costs) == {2, 3}
    assert (costs[2]["Total_Estimated_Cost"], costs[3]["Total_Estimated_Cost"]) == (D(100), D(80))
    assert sorted(r["Job_Cost_ID"] for r in costs.values()) == [5, 6]
    estimate_of = {r["submission_id"]: r["Estimate_ID"] for r in done.rows["Estimate"].collect()}
    assert all(costs[n]["Estimate_ID"] == estimate_of[n] for n in costs)
    # Both rows or neither.
    assert reasons(done.rejects) == {4: "Service_ID is unknown", 5: "Employee_ID is unknown"}
    by_employee = ingest.ingest_estimates(batch, tables, with_costing=False)
    assert set(by_employee.rows) == {"Estimate"}
    assert by_employee.rows["Estimate"].count() == 5


def test_invoices(spark, tables):
    done = ingest.ingest_invoices(forms(spark, "contract_id long, client_id long, invoice_date string, due_date string,"
                                               " total_amount string, amount_paid string", [
        (1, 1, 1, "2024-05-01", None, "100", "0"), (2, 1, 1, "2024-05-01", "2024-05-09", "100", "100"),
        (3, 1, 1, None, None, "100", "0.01"), (4, None, 1, None, None, "1", "0"), (5, 8, 1, None, None, "1", "0"),
        (6, 1, 1, None, None, None, None), (7, 1, 1, None, None, "1", "x")]), tables)
    rows = {r["submission_id"]: r for r in done.rows["Invoice"].collect()}
    assert {n: r["Invoice_Status"] for n, r in rows.items()} == {1: "Unpaid", 2: "Paid", 3: "Partial", 6: "Unpaid"}
    assert (rows[1]["Due_Date"], rows[2]["Due_Date"], rows[3]["Due_Date"]) == (
        datetime.date(2024, 5, 16), datetime.date(2024, 5, 9), None)
    assert reasons(done.rejects) == {
        4: "Contract_ID is required", 5: "Contract_ID is unknown", 7: "Amount_Paid does not fit decimal(10,2)"}


def test_job_costs(spark, tables):
    done = ingest.ingest_job_costing(forms(
        spark, "service_id string, estimate_id string, total_actual_cost string, total_estimated_cost string", [
            (1, "1", "", "10.10", "10"), (2, "", "1", "1", "1"), (3, "1", "1", "5", "5"), (4, "1", "1", None, "5")]), tables)
    rows = {r["submission_id"]: (r["Variance"], r["Budget_Status"]) for r in done.rows["Job_Costing"].collect()}
    assert rows == {1: (D("0.10"), "Over Budget"), 3: (D(0), "On Budget"), 4: (D(-5), "Under Budget")}
    assert reasons(done.rejects) == {2: "Service_ID is required"}


def test_referrals(spark, tables):
    done = ingest.ingest_referrals(forms(spark, "referee_name string, referrer_id string", [
        (1, " Sue ", ""), (2, " ", "1"), (3, "Joe", "1"), (4, "Max", "88")]), tables, DAY)
    rows = {r["submission_id"]: r for r in done.rows["Referral"].collect()}
    assert {n: (r["Referee_Name"], r["Referrer_ID"], r["Status"]) for n, r in rows.items()} == {
        1: ("Sue", None, "Pending"), 3: ("Joe", 1, "Pending")}
    assert reasons(done.rejects) == {2: "Referee_Name is required", 4: "Referrer_ID is unknown"}


def test_last_status_change_counts(spark, tables):
    done = ingest.apply_status_changes(forms(spark, "employee_id string, is_active string", [
        (1, "1", "0"), (2, "1", "1"), (3, "2", "0"), (4, "8", "1"), (5, "3", None)]), tables)
    assert {r["Employee_ID"]: r["Is_Available"] for r in done.rows["Employee"].collect()} == {1: 1, 2: 0, 3: 0}
    assert reasons(done.rejects) == {4: "Employee_ID is unknown", 5: "is_active is required"}


def test_accepted_rows_can_be_appended(spark, tables, tmp_path):
    path = str(tmp_path)
    for table, rows in tables.items():
        append(rows, path, table)
    stored = load_tables(spark, path)
    done = ingest.ingest_estimate_requests(forms(
        spark, "client_name string, property_address string, service_description string",
        [(n, f"Client {n}", "Road", "Mow") for n in range(20)]), stored, DAY).settled()
    for table, rows in done.rows.items():
        append(rows, path, table)
    after = load_tables(spark, path)
    assert sorted(column(after["Client"], "Client_ID")) == list(range(1, 26))
    assert quality.orphan_counts(after, "Estimate").count() == 0


# ── payments ─────────────────────────────────────────────────────────────────────────────────


def settle(spark, tables, rows, compat=False):
    batch = spark.createDataFrame(rows, "Payment_ID long, Invoice_ID long, Payment_Amount decimal(10,2)")
    after = payments.apply_payments(tables["Invoice"], batch, compat)
    assert after.columns == tables["Invoice"].columns
    return {r["Invoice_ID"]: (r["Amount_Paid"], r["Invoice_Status"]) for r in after.collect()}


def test_half_payment(spark, tables):
    rows = [(1, 4, D(125))]
    assert settle(spark, tables, rows)[4] == (D(125), "Partial")
    # The stored status counts the payment twice.
    assert settle(spark, tables, rows, compat=True)[4] == (D(125), "Paid")


def test_several_payments_and_untouched_invoices(spark, tables):
    after = settle(spark, tables, [(1, 3, D(60)), (2, 3, D(40)), (3, 6, D(400)), (4, None, D(9)), (5, 5, D(0))])
    assert after[3] == (D(100), "Paid")
    assert after[6] == (D(400), "Paid")
    assert after[5] == (D(100), "Partial")
    assert after[8] == (D(0), "Overdue")
    assert len(after) == 10
    compat = settle(spark, tables, [(1, 3, D(60)), (2, 3, D(20))], compat=True)
    assert compat[3] == (D(80), "Paid")


def test_payment_forms(spark, tables):
    done = ingest.ingest_payments(forms(spark, "contract_id long, invoice_id string, payment_amount string", [
        (1, 1, "1", "350"), (2, 1, None, "5"), (3, None, "1", "5"), (4, 1, "77", "5"), (5, 1, "1", None)]), tables)
    rows = done.rows["Payment"]
    assert sorted(column(rows, "Payment_ID")) == [7, 8]
    assert reasons(done.rejects) == {
        3: "Contract_ID is required", 4: "Invoice_ID is unknown", 5: "Payment_Amount is required"}
    after = payments.apply_payments(tables["Invoice"], rows)
    assert {r["Invoice_ID"]: r["Invoice_Status"] for r in after.collect()}[1] == "Paid"
