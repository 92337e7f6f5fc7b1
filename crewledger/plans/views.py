"""The reporting views under the names users select from."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from crewledger.operators import clients, costing, crew, estimates, invoices, revenue
from crewledger.schemas import SCHEMAS
from crewledger.sources.tables import Tables


# The view names.
NAMES = [
    "vw_ClientFeedback", "vw_EstimateEmployees", "vw_ServiceEmployees", "vw_PaymentsThisMonth",
    "vw_RevenueByServiceType", "vw_TopClientsByRevenue", "vw_RevenueByLocation", "vw_MonthlyRevenueReport",
    "vw_OutstandingInvoices", "vw_ClientServiceHistory", "vw_JobCostingReport", "vw_ScheduleWorkload",
    "vw_Employee_Clients",
]


def views(tables: Tables, as_of: str | datetime.date | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every reporting view, made when called; unsorted: who selects from a view orders it."""
    return {
        "vw_ClientFeedback": lambda: clients.vw_client_feedback(tables, ordered=False),
        "vw_EstimateEmployees": lambda: estimates.vw_estimate_employees(tables),
        "vw_ServiceEmployees": lambda: crew.vw_service_employees(tables, ordered=False),
        "vw_PaymentsThisMonth": lambda: invoices.vw_payments_this_month(tables, as_of, ordered=False),
        "vw_RevenueByServiceType": lambda: revenue.vw_revenue_by_service_type(tables, ordered=False),
        "vw_TopClientsByRevenue": lambda: revenue.vw_top_clients_by_revenue(tables, ordered=False),
        "vw_RevenueByLocation": lambda: revenue.vw_revenue_by_location(tables, ordered=False),
        "vw_MonthlyRevenueReport": lambda: revenue.vw_monthly_revenue_report(tables, ordered=False),
        "vw_OutstandingInvoices": lambda: invoices.vw_outstanding_invoices(tables, as_of, ordered=False),
        "vw_ClientServiceHistory": lambda: clients.vw_client_service_history(tables, ordered=False),
        "vw_JobCostingReport": lambda: costing.vw_job_costing(tables, ordered=False),
        "vw_ScheduleWorkload": lambda: crew.schedule_workload(tables, as_of, ordered=False),
        "vw_Employee_Clients": lambda: crew.employee_clients(tables),
    }


def register_views(
    spark: SparkSession, tables: Tables, as_of: str | datetime.date | None = None, names: Iterable[str] | None = None
) -> list[str]:
    """Make the tables and the views, or those named, available to `spark.sql`; returns the view names."""
    catalogue = views(tables, as_of)
    for name in SCHEMAS if names is None else ():
        tables[name].createOrReplaceTempView(name)
    chosen = list(catalogue if names is None else names)
    for name in chosen:
        catalogue[name]().createOrReplaceTempView(name)
    return chosen
