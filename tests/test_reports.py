"""Report semantics on the small company, mostly tallied by hand."""

from __future__ import annotations

import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from crewledger.operators import clients, costing, crew, estimates, invoices, revenue, services, totals
from crewledger.plans.views import register_views
from tests.fixture import AS_OF, as_dicts, column


def day(text):
    return datetime.date.fromisoformat(text)


# ── look-ups and filters ─────────────────────────────────────────────────────────────────────


def test_client_lists(tables):
    assert column(clients.clients_list(tables), "Client_ID") == [1, 2, 5, 3, 4]
    assert clients.clients_full(tables).columns == [
        "Client_ID", "Client_Name", "Client_Phone", "Client_Email", "Property_Address"]
    assert column(clients.client_by_id(tables, "3"), "Client_Name") == ["Lee Marsh"]
    assert clients.client_by_id(tables, "").count() == 0
    assert clients.client_by_id(tables, "three").count() == 0


def test_employees(tables):
    assert column(crew.employees_list(tables), "Employee_Name") == ["Abe Lund", "Mia Noor", "Zoe Hart"]
    assert column(crew.service_employees(tables), "Employee_Email") == ["abe@x", "zoe@x"]
    assert "Employee_Email" not in crew.vw_service_employees(tables).columns
    assert as_dicts(crew.employee_lookup(tables, 3)) == [
        {"Employee_ID": 3, "Employee_Name": "Mia Noor", "Employee_Role": None, "Is_Available": 0}]
    assert crew.employee_lookup(tables, None).count() == 0
    assert crew.employee_lookup(tables, 9).count() == 0
    assert crew.employee_count(tables).first()[0] == 3


def test_employee_lookups_flag_unknown_ids(tables, spark):
    wanted = spark.createDataFrame([(1,), (1,), (8,)], "id long")
    found = {row["Employee_ID"]: row["Found"] for row in crew.employee_lookups(tables, wanted).collect()}
    assert found == {1: True, 8: False}


def test_services_by_client(tables, spark):
    assert column(services.services_by_client(tables, 1), "Service_ID") == [4, 3, 2, 1]
    assert column(services.services_by_client(tables, "2"), "Service_ID") == [5, 7, 8]
    assert services.services_by_client(tables, "").count() == 0
    both = spark.createDataFrame([(1,), (5,)], "id long")
    assert services.services_by_client(tables, both).count() == 5


def test_contracts(tables):
    assert column(invoices.contracts_list(tables), "Contract_ID") == [6, 5, 4, 3, 2, 1]
    assert column(invoices.contracts_for_client(tables, "Kim Field"), "Contract_ID") == [5, 4, 3]
    assert column(invoices.contracts_for_client(tables, client_id=5), "Contract_ID") == [4]


def test_invoices_by_client(tables):
    rows = as_dicts(invoices.invoices_by_client(tables, 1))
    assert [(r["Invoice_ID"], r["Balance_Due"]) for r in rows] == [(3, D(100)), (2, D(0)), (1, D(350))]
    assert invoices.invoices_by_client(tables).count() == 10
    undated_last = column(invoices.invoices_by_client(tables, "5"), "Invoice_ID")
    assert undated_last == [6, 5, 9]


def test_filter_invoices(tables):
    rows = invoices.all_invoices(tables)
    assert column(invoices.filter_invoices(rows, 5, "Partial"), "Invoice_ID") == [5]
    assert invoices.filter_invoices(rows, "", "").count() == 10


def test_services_report(tables):
    rows = services.services_report(tables, description=" TRIM ")
    assert sorted(column(rows, "Service_ID")) == [1, 2]
    dated = services.services_report(tables, client_id=2, date_from="2024-01-01", date_to="2024-07-01")
    assert column(dated, "Service_ID") == [7]
    summary = totals.service_totals(services.services_report(tables)).first()
    assert tuple(summary) == (8, 4, 3)
    assert column(services.service_types(tables), "Service_Type") == ["Haul", "Roof", "Trim"]


def test_referrals(tables):
    rows = as_dicts(clients.referrals(tables))
    assert [r["Referral_ID"] for r in rows] == [4, 2, 3, 1]
    assert [r["Referrer_Name"] for r in rows] == ["Kim Field", None, None, "Ada Brook"]
    assert [r["Referee_Client_Name"] for r in rows] == ["Lee Marsh", None, None, "Kim Field"]
    assert column(clients.referrals(tables, "77"), "Referral_ID") == [3]
    listed = clients.referrals(tables)
    assert column(clients.filter_referrals(listed, " 100%"), "Referral_ID") == [3]
    assert clients.filter_referrals(listed, "  ").count() == 4
    assert column(clients.sort_referrals(listed, "Referee_Name", True), "Referral_ID") == [3, 2, 1, 4]
    assert column(clients.sort_referrals(listed, "Referrer_ID", True), "Referral_ID") == [2, 1, 4, 3]
    assert column(estimates.fill_labels(listed), "Status") == ["Pending", "Pending", "Contacted", "Verified"]


def test_estimates(tables):
    rates = {r["Estimate_ID"]: r["Hourly_Rate"] for r in estimates.with_hourly_rate(tables["Estimate"]).collect()}
    assert rates == {1: D(100), 2: D("33.33"), 3: D("62.50"), 4: D(150), 5: D(80), 6: D(0), 7: D(0)}
    assert column(estimates.estimate_employees(tables, month="1", year="2024"), "Estimate_ID") == [2, 1]
    assert sorted(column(estimates.estimate_employees(tables, month=1), "Estimate_ID")) == [1, 2, 4]
    # A filter on the employee leaves the unassigned estimate out.
    assert column(estimates.estimate_employees(tables, year=2024, employee_id="2"), "Estimate_ID") == [3]
    assert estimates.vw_estimate_employees(tables).count() == 7
    everything = estimates.all_estimates(tables)
    assert column(estimates.filter_estimates(everything, 1, "1"), "Estimate_ID") == [2, 1]
    assert column(estimates.estimate_by_id(tables, 5), "Employee_Name") == [None]
    assert column(estimates.fill_labels(estimates.estimate_by_id(tables, 5)), "Employee_Name") == ["Unassigned"]
    summary = totals.estimate_totals(everything).first()
    assert (summary["Estimate_Count"], summary["Total_Cost"], summary["Total_Hours"]) == (7, D(1480), D(22))
    assert summary["Avg_Cost"] == D("211.428571")
    none = totals.estimate_totals(everything.filter("Estimate_ID < 0")).first()
    assert (none["Estimate_Count"], none["Total_Cost"], none["Avg_Cost"]) == (0, D(0), D(0))
    draft = estimates.contract_draft_from_estimates(estimates.estimate_by_id(tables, 1)).first()
    assert tuple(draft) == (1, 1, D(700), "Hedge")


# ── listings ─────────────────────────────────────────────────────────────────────────────────


def test_feedback_with_and_without_a_service(tables):
    assert column(clients.client_feedback(tables), "Feedback_ID") == [1, 2]
    assert column(clients.client_feedback(tables, rating="3"), "Feedback_ID") == [2]
    assert column(clients.client_feedback(tables, client_id=1, rating=3), "Feedback_ID") == []
    viewed = as_dicts(clients.vw_client_feedback(tables))
    assert [(r["Feedback_ID"], r["Service_ID"]) for r in viewed] == [(4, None), (3, None), (1, 1), (2, 5)]


def test_payments_this_month(tables):
    rows = as_dicts(invoices.vw_payments_this_month(tables, "2024-07-20"))
    assert [(r["Payment_ID"], r["Client_Name"], r["Invoice_ID"], r["Invoice_Total"]) for r in rows] == [
        (3, "Ada Brook", 2, D(300)), (5, "Ada Brook", None, None), (2, "Ada Brook", 2, D(300))]


def test_monthly_revenue(tables):
    assert column(invoices.monthly_revenue(tables, "3", "2024"), "Invoice_ID") == [7, 3, 4, 2]
    assert column(invoices.monthly_revenue(tables, month="3"), "Invoice_ID") == [7, 3, 4, 2, 6]
    assert column(invoices.monthly_revenue(tables, year=2023), "Invoice_ID") == [6, 5]
    assert invoices.monthly_revenue(tables).count() == 10


def test_aging_at_every_boundary(tables):
    short = {r["Invoice_ID"]: (r["Days_Overdue"], r["Aging_Bucket"])
             for r in invoices.outstanding_invoices(tables, AS_OF).collect()}
    assert short == {
        1: (0, "Current"), 3: (30, "1-30 Days"), 4: (31, "31-60 Days"), 5: (60, "31-60 Days"),
        6: (61, "60+ Days"), 7: (90, "60+ Days"), 9: (None, "60+ Days")}
    listed = as_dicts(invoices.vw_outstanding_invoices(tables, AS_OF))
    # The view also shows a status neither list names, and never a NULL one.
    assert {r["Invoice_ID"]: r["Aging_Bucket"] for r in listed} == {
        1: "Current", 3: "1-30 Days", 4: "31-60 Days", 5: "31-60 Days", 6: "61-90 Days", 7: "61-90 Days",
        8: "Over 90 Days", 9: "Over 90 Days"}
    assert [r["Invoice_ID"] for r in listed] == [8, 7, 6, 5, 4, 3, 1, 9]
    shown = invoices.days_overdue_clamped(invoices.outstanding_invoices(tables, "2024-06-15"))
    assert {r["Invoice_ID"]: r["Days_Overdue"] for r in shown.collect()} == {
        1: 0, 3: 14, 4: 15, 5: 44, 6: 45, 7: 74, 9: 0}


def test_recent_outstanding(tables):
    rows = as_dicts(invoices.recent_outstanding(tables, AS_OF))
    assert [r["Invoice_ID"] for r in rows] == [7, 6, 5, 4, 3]
    assert {r["More_Count"] for r in rows} == {2}
    assert {r["More_Count"] for r in as_dicts(invoices.recent_outstanding(tables, AS_OF, 50))} == {0}


def test_service_history_patterns(tables):
    def at(location):
        return sorted(set(column(clients.client_service_history(tables, location=location), "Service_ID")))

    assert at("100% p") == [1, 2]
    assert at("north_lane") == [3, 4]
    assert at("NORTH") == [3, 4]
    assert clients.client_service_history(tables, client_id=2).count() == 4


def test_job_costing(tables):
    rows = as_dicts(costing.job_costing(tables))
    assert [(r["Job_Cost_ID"], r["Variance"], r["Budget_Status"]) for r in rows] == [
        (3, D(0), "On Budget"), (2, D(10), "Over Budget"), (1, D(-300), "Under Budget"),
        (4, D("10.10"), "Over Budget")]
    assert {(r["Grand_Total_Actual"], r["Grand_Total_Estimated"]) for r in rows} == {(D("1070.10"), D(1350))}
    july = as_dicts(costing.job_costing(tables, month="7", year="2024"))
    assert {(r["Job_Cost_ID"], r["Grand_Total_Actual"]) for r in july} == {(2, D(360)), (3, D(360))}
    assert column(costing.job_costing(tables, estimate_id="2"), "Grand_Total_Actual") == [D(110)]
    assert costing.job_costing(tables, estimate_id="99").count() == 0
    summary = totals.job_cost_totals(costing.vw_job_costing(tables)).first()
    assert tuple(summary) == (4, D(1350), D("1070.10"), D("-279.90"))


def test_schedule(tables):
    rows = as_dicts(crew.schedule_workload(tables, AS_OF))
    assert [(r["Service_ID"], r["Employee_Name"], r["Status"]) for r in rows] == [
        (6, "Abe Lund", "Completed"), (1, "Abe Lund", "Completed"), (1, "Zoe Hart", "Completed"),
        (2, "Abe Lund", "Completed"), (3, "Abe Lund", "Completed"), (4, "Zoe Hart", "Today"),
        (5, "Mia Noor", "Upcoming")]


def test_employee_clients(tables):
    rows = {(r["Employee_ID"], r["Client_ID"]): r for r in crew.employee_clients(tables).collect()}
    assert set(rows) == {(1, 1), (2, 1), (2, 5), (3, 2)}
    assert (rows[2, 1]["Times_Served"], rows[2, 1]["Last_Service_Date"]) == (3, day("2024-03-02"))
    # The greatest text, not the latest.
    assert rows[2, 1]["Last_Description"] == "trim again"
    assert column(crew.my_clients(tables, "2"), "Client_ID") == [1, 5]
    assert crew.my_clients(tables, None).count() == 0


# ── revenue ──────────────────────────────────────────────────────────────────────────────────


def test_revenue_counts_an_invoice_once_per_service(tables):
    rows = {r["Service_Type"]: r for r in revenue.revenue_by_service(tables).collect()}
    # Trim: contract 1 (1000) twice and contract 3 (250) once, over five pairs.
    assert (rows["Trim"]["Total_Services"], rows["Trim"]["Total_Revenue"]) == (3, D(2250))
    assert rows["Trim"]["Avg_Revenue"] == D(450)
    # Haul: contract 1 (1000) and contract 4 (610.50); the service without a contract is out.
    assert (rows["Haul"]["Total_Services"], rows["Haul"]["Total_Revenue"]) == (2, D("1610.50"))
    assert (rows["Haul"]["First_Service"], rows["Haul"]["Latest_Service"]) == (day("2023-02-01"), day("2024-03-02"))
    # Roof: contract 2 (100) and contract 5 (80 + 20 + NULL); the NULL is not averaged.
    assert (rows["Roof"]["Total_Revenue"], rows["Roof"]["Avg_Revenue"]) == (D(200), D("66.666667"))
    viewed = {r["Service_Type"]: r["Total_Services"] for r in revenue.vw_revenue_by_service_type(tables).collect()}
    assert viewed == {"Trim": 5, "Haul": 5, "Roof": 4}
    assert column(revenue.revenue_by_service(tables, "Roof"), "Total_Services") == [2]


def test_revenue_with_each_invoice_once(tables):
    rows = {r["Service_Type"]: r["Total_Revenue"]
            for r in revenue.revenue_by_service(tables, dedupe_invoices=True).collect()}
    assert rows == {"Trim": D(1250), "Haul": D("1610.50"), "Roof": D(200)}


def test_revenue_by_location(tables):
    rows = {r["Property_Location"]: (r["Total_Services"], r["Total_Revenue"])
            for r in revenue.vw_revenue_by_location(tables).collect()}
    assert rows == {
        "100% Palm Court": (4, D(2000)), "north lane": (2, D(1000)), "North Lane": (1, D(100)),
        "West End": (3, D("610.50")), "South Row": (3, D(100))}


def test_groups_that_differ_in_case(tables):
    rows = revenue.vw_revenue_by_location(tables, ignore_case=True).collect()
    merged = {r["Property_Location"].lower(): (r["Total_Services"], r["Total_Revenue"]) for r in rows}
    assert len(rows) == 4
    assert merged["north lane"] == (3, D(1100))
    assert column(revenue.revenue_by_service(tables, "ROOF", ignore_case=True), "Total_Services") == [2]
    assert revenue.revenue_by_service(tables, "ROOF").count() == 0
    assert revenue.vw_revenue_by_service_type(tables, ignore_case=True).count() == 3
    assert revenue.vw_monthly_revenue_report(tables, ignore_case=True).count() == \
        revenue.vw_monthly_revenue_report(tables).count()


def test_monthly_report_groups_by_name(tables):
    rows = as_dicts(revenue.vw_monthly_revenue_report(tables))
    kim = [(r["Revenue_Year"], r["Revenue_Month"], r["Service_Type"], r["Total_Revenue"], r["Total_Received"])
           for r in rows if r["Client_Name"] == "Kim Field"]
    assert sorted(kim, key=str) == sorted([
        (2024, 7, "Trim", D(250), D(0)), (2023, 2, "Haul", D("610.50"), D(100)),
        (None, None, "Roof", D(100), D(5))], key=str)


def test_top_clients(tables, spark):
    rows = as_dicts(revenue.top_clients(tables))
    assert [(r["Client_ID"], r["Total_Contracts"], r["Total_Billed"], r["Total_Collected"], r["Outstanding_Balance"])
            for r in rows] == [
        (1, 2, D(1100), D(650), D(450)), (5, 1, D("610.50"), D(100), D("510.50")), (2, 2, D(350), D(5), D(345))]
    assert column(revenue.top_clients(tables, "2"), "Client_ID") == [1, 5]
    assert revenue.vw_top_clients_by_revenue(tables).count() == 3
    assert column(clients.rank_clients(tables, 10, "5"), "Rank") == [1]
    assert column(clients.rank_clients(tables, 10, "5", keep_global_rank=True), "Rank") == [2]


def test_equal_sums_are_cut_by_id(tables):
    same = tables["Invoice"].withColumn("Amount_Paid", F.lit(1).cast("decimal(10,2)")).filter("Invoice_ID IN (1, 4, 5)")
    assert column(revenue.top_clients(tables | {"Invoice": same}, 2), "Client_ID") == [1, 2]


def test_dashboard(tables):
    assert tuple(revenue.dashboard_stats(tables).first()) == (5, 6, 7, D("2060.50"))
    empty = tables | {"Invoice": tables["Invoice"].limit(0)}
    assert tuple(revenue.dashboard_stats(empty).first()) == (5, 6, 0, D(0))


# ── periods and totals ───────────────────────────────────────────────────────────────────────


def test_periods_overlap_and_count_once_each(tables, spark):
    asked = spark.createDataFrame(
        [(3, 2024), (3, 2024), (3, None), (None, 2023), (None, None), (9, 2030)], "Month int, Year int")
    rows = invoices.period_totals(invoices.monthly_revenue(tables), asked)
    by_period = {r["Period"]: (r["Invoice_Count"], r["Total_Billed"], r["Total_Collected"]) for r in rows.collect()}
    assert by_period == {
        "3-2024": (4, D(730), D(300)), "3-all": (5, D("1030.50"), D(300)), "all-2023": (2, D("600.50"), D(100)),
        "all-all": (10, D("2060.50"), D(755)), "9-2030": (0, D(0), D(0))}
    total = invoices.grand_total(rows).first()
    assert tuple(total) == (5, 21, D("4421.50"), D(1455), D("2966.50"))


def test_monthly_chart(tables):
    rows = {(r["Year"], r["Month"]): (r["Invoice_Count"], r["Total_Billed"], r["Bar_Height"])
            for r in invoices.monthly_chart(tables["Invoice"]).collect()}
    assert rows[2024, 3] == (4, D(730), 140)
    assert rows[2024, 2] == (1, D(700), 134)
    assert rows[2024, 4] == (1, D(20), 4)
    assert rows[2024, 5] == (1, D(0), 4)


def test_invoice_totals_and_total_row(tables):
    open_set = tables["Invoice"].filter(F.col("Invoice_Status").isin("Unpaid", "Partial"))
    assert tuple(totals.invoice_totals(open_set).first()) == (7, D("1740.50"), D(450), D("1290.50"))
    assert tuple(totals.invoice_totals(open_set.limit(0)).first()) == (0, D(0), D(0), D(0))
    rows = as_dicts(totals.with_total_row(open_set.select("Invoice_ID", "Total_Amount"), ["Total_Amount"]))
    assert len(rows) == 8
    assert [r for r in rows if r["Row_Kind"] == "total"] == [
        {"Invoice_ID": None, "Total_Amount": D("1740.50"), "Row_Count": 7, "Row_Kind": "total"}]


# ── views ────────────────────────────────────────────────────────────────────────────────────


def test_views_can_be_queried(spark, tables):
    names = register_views(spark, tables, AS_OF)
    assert len(names) == 13
    for name in names:
        assert spark.table(name).columns
    bucket = spark.sql(
        "SELECT Aging_Bucket, count(*) AS n FROM vw_OutstandingInvoices GROUP BY Aging_Bucket").collect()
    assert {r["Aging_Bucket"]: r["n"] for r in bucket}["61-90 Days"] == 2
    joined = spark.sql("SELECT e.Client_Name FROM vw_Employee_Clients e JOIN Client c USING (Client_ID)")
    assert joined.count() == 4


def test_history_view_keeps_everyone(tables):
    rows = as_dicts(clients.vw_client_service_history(tables))
    assert [r["Client_ID"] for r in rows if r["Estimate_ID"] is None] == [4]
    no_contract = [r for r in rows if r["Estimate_ID"] == 7]
    assert [(r["Contract_ID"], r["Service_ID"]) for r in no_contract] == [(None, None)]
    bare = [r for r in rows if r["Contract_ID"] == 6]
    assert [(r["Service_ID"], r["Invoice_ID"], r["Payment_ID"]) for r in bare] == [(None, None, None)]
    # Contract 1: three services times invoice 1 with one payment and invoice 2 with two.
    assert len([r for r in rows if r["Contract_ID"] == 1]) == 9
    assert [r["Client_Name"] for r in rows] == sorted(r["Client_Name"] for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_history_and_revenue_against_nested_loops(spark, tables, seed):
    from tests import brute

    data = brute.random_company(seed)
    small = tables | brute.frames(spark, data)
    assert brute.same_rows(clients.vw_client_service_history(small), brute.history(data))
    assert brute.same_rows(
        revenue.revenue_by_service(small).select("Service_Type", "Total_Services", "Total_Revenue"),
        brute.revenue_by_type(data, dedupe=False))
    assert brute.same_rows(
        revenue.revenue_by_service(small, dedupe_invoices=True).select("Service_Type", "Total_Services", "Total_Revenue"),
        brute.revenue_by_type(data, dedupe=True))
    assert brute.same_rows(
        revenue.vw_top_clients_by_revenue(small).select("Client_ID", "Total_Contracts", "Total_Billed", "Total_Collected"),
        brute.client_revenue(data))
