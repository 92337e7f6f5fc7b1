"""Report figures of random companies against nested loops."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest

from crewledger.operators import clients, costing, crew, invoices, quality, revenue, totals
from crewledger.operators.payments import apply_payments, overflowing
from crewledger.schemas import SCHEMAS
from crewledger.sources.tables import append, read_table
from tests.brute import client_revenue, random_company
from tests.fixture import column, frame

TODAY = datetime.date(2024, 9, 1)


def company(seed: int) -> dict[str, list[dict]]:
    """A random company with statuses, due dates, job costs and crews."""
    r, data = random.Random(seed), random_company(seed)
    for row in data["Invoice"]:
        row["Invoice_Status"] = r.choice(["Paid", "Unpaid", "Partial"])
        row["Due_Date"] = TODAY - datetime.timedelta(days=r.choice([-3, 0, 1, 30, 31, 60, 61, 90, 91]))

    def blank(table, **values):
        return {name: values.get(name) for name in SCHEMAS[table].names}

    data["Employee"] = [blank("Employee", Employee_ID=n, Employee_Name=f"E{n}", Is_Available=n % 2) for n in range(1, 5)]
    data["Service_Employee"] = [
        blank("Service_Employee", Service_ID=s["Service_ID"], Employee_ID=n)
        for s in data["Service"] for n in r.sample(range(1, 5), r.randrange(3))]
    data["Job_Costing"] = [
        blank("Job_Costing", Job_Cost_ID=n, Service_ID=r.randrange(1, 30), Estimate_ID=1,
              Total_Actual_Cost=Decimal(r.randrange(900)), Total_Estimated_Cost=Decimal(r.randrange(900)))
        for n in range(1, 15)]
    return data


@pytest.fixture(scope="module", params=[1, 2])
def business(request, spark):
    data = company(request.param)
    return data, {table: frame(spark, table, rows) for table, rows in data.items()}


def test_dashboard(business):
    data, tables = business
    unsettled = sum(i["Invoice_Status"] != "Paid" for i in data["Invoice"])
    billed = sum(i["Total_Amount"] or 0 for i in data["Invoice"])
    assert tuple(revenue.dashboard_stats(tables).first()) == (len(data["Client"]), len(data["Contract"]), unsettled, billed)


def test_aging(business):
    data, tables = business
    names = {c["Client_ID"] for c in data["Client"]}
    wanted = {
        i["Invoice_ID"]: (TODAY - i["Due_Date"]).days
        for i in data["Invoice"] if i["Invoice_Status"] != "Paid" and i["Client_ID"] in names}
    rows = invoices.outstanding_invoices(tables, TODAY).collect()
    assert {r["Invoice_ID"]: r["Days_Overdue"] for r in rows} == wanted
    assert [r["Days_Overdue"] for r in rows] == sorted(wanted.values(), reverse=True)


def test_top_clients(business):
    data, tables = business
    found = {r["Client_ID"]: (r["Total_Contracts"], r["Total_Billed"], r["Total_Collected"]) for r in revenue.top_clients(tables, 50).collect()}
    assert found == {client: tuple(rest) for client, *rest in client_revenue(data)}


def test_job_costs(business):
    data, tables = business
    services = {s["Service_ID"]: s for s in data["Service"]}
    names = {c["Client_ID"] for c in data["Client"]}
    shown = [j for j in data["Job_Costing"] if j["Service_ID"] in services and services[j["Service_ID"]]["Client_ID"] in names]
    rows = costing.job_costing(tables).collect()
    assert sorted(r["Job_Cost_ID"] for r in rows) == [j["Job_Cost_ID"] for j in shown]
    assert {r["Grand_Total_Actual"] for r in rows} == {sum(j["Total_Actual_Cost"] for j in shown)}
    assert totals.job_cost_totals(costing.vw_job_costing(tables)).first()[0] == len(shown)


def test_schedule_and_crew(business):
    data, tables = business
    assert column(crew.service_employees(tables), "Employee_ID") == [1, 3]
    services = {s["Service_ID"]: s["Client_ID"] for s in data["Service"]}
    names = {c["Client_ID"] for c in data["Client"]}
    wanted: dict = {}
    for a in data["Service_Employee"]:
        client = services[a["Service_ID"]]
        if client in names:
            wanted.setdefault((a["Employee_ID"], client), set()).add(a["Service_ID"])
    twice = tables | {"Service_Employee": tables["Service_Employee"].union(tables["Service_Employee"])}
    for stored in (tables, twice):
        rows = crew.employee_clients(stored).collect()
        assert {(r["Employee_ID"], r["Client_ID"]): r["Times_Served"] for r in rows} == {k: len(v) for k, v in wanted.items()}


def test_repeated_parents_and_null_keys(business, spark):
    _, tables = business
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 99)], "submission_id long, Client_ID long")
    doubled = tables["Client"].union(tables["Client"])
    checked = quality.check_foreign_key(rows, "Client_ID", doubled, "submission_id")
    assert sorted(column(checked.accepted, "submission_id")) == [1, 2, 3]
    keyed = spark.createDataFrame([(None,), (None,), (3,), (4,), (4,)], "k int")
    checked = quality.check_unique(keyed, ["k"])
    assert column(checked.accepted, "k") == [3]
    assert checked.rejects.count() == 4


def test_contract_stored_twice_counts_once(business):
    _, tables = business
    twice = tables | {"Contract": tables["Contract"].union(tables["Contract"])}
    once = {r["Client_ID"]: r["Total_Contracts"] for r in revenue.top_clients(tables, 50).collect()}
    assert {r["Client_ID"]: r["Total_Contracts"] for r in revenue.top_clients(twice, 50).collect()} == once


def test_balances_are_stored_and_read(business, spark, tmp_path):
    _, tables = business
    paid = apply_payments(tables["Invoice"], tables["Payment"])
    append(paid, str(tmp_path), "Invoice")
    found = read_table(spark, str(tmp_path), "Invoice")
    assert sorted(map(str, found.collect())) == sorted(map(str, paid.select(found.columns).collect()))


def test_amounts_that_do_not_fit(spark, tmp_path):
    kinds = "Invoice_ID long, Total_Amount decimal(10,2), Amount_Paid decimal(10,2), Invoice_Status string"
    invoice = spark.createDataFrame([(1, Decimal(5), Decimal("99999999.00"), "Partial"), (2, Decimal(5), Decimal(0), "Unpaid")], kinds)
    payment = spark.createDataFrame([(1, 1, Decimal(5)), (2, 2, Decimal(5))], "Payment_ID long, Invoice_ID long, Payment_Amount decimal(10,2)")
    after = {r["Invoice_ID"]: (r["Amount_Paid"], r["Invoice_Status"]) for r in apply_payments(invoice, payment).collect()}
    assert after == {1: (Decimal("99999999.00"), "Partial"), 2: (Decimal(5), "Paid")}
    assert column(overflowing(invoice, payment), "Invoice_ID") == [1]
    wide = spark.createDataFrame([(1, 1, Decimal("123456789.00"))], "Payment_ID long, Contract_ID long, Payment_Amount decimal(12,2)")
    rows = wide.selectExpr("*", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in SCHEMAS["Payment"] if f.name not in wide.columns])
    with pytest.raises(Exception, match="does not fit"):
        append(rows, str(tmp_path), "Payment")


def test_filters_that_match_nothing(business):
    _, tables = business
    for month, year in ((13, 2024), ("x", None), (0, 2024), (None, 0), (None, 10_000), ("x", 2024)):
        assert invoices.monthly_revenue(tables, month=month, year=year).count() == 0
    assert invoices.monthly_revenue(tables, year=9999).count() == 0
    assert clients.client_service_history(tables, location="a\\b").count() == 0
