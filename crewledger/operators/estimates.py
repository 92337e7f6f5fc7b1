"""Estimates with their estimators, rates, labels and the contract drafts made from them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewledger.functions.money import hourly_rate
from crewledger.functions.text import label_or
from crewledger.operators.filters import is_open, match_ids, whole_number
from crewledger.operators.joins import lookup
from crewledger.operators.order import listing
from crewledger.sources.tables import Tables, in_stored_period


def _with_people(tables: Tables, estimates: DataFrame) -> DataFrame:
    """Estimates with the client's name and, where assigned, the estimator."""
    named = estimates.join(tables["Client"].select("Client_ID", "Client_Name"), "Client_ID")
    estimators = tables["Employee"].select(
        "Employee_ID", F.col("Employee_ID").alias("Estimator_ID"), "Employee_Name", "Employee_Role")
    joined = lookup(named, estimators, "Employee_ID", "Estimate_ID").drop("Employee_ID")
    return joined.withColumnRenamed("Estimator_ID", "Employee_ID")


@listing("-Estimate_Date", "Estimate_ID")
def estimate_employees(
    tables: Tables, month: Any = None, year: Any = None, employee_id: Any = None
) -> DataFrame:
    """Estimates of a period with their estimator, newest first.

    A filter on the employee leaves unassigned estimates out.
    """
    estimates = in_stored_period(tables["Estimate"], "Estimate_Date", whole_number(month), whole_number(year))
    rows = match_ids(_with_people(tables, estimates), "Employee_ID", employee_id)
    return rows.select(
        "Estimate_ID", "Client_Name", "Property_Address", "Service_Description", "Estimated_Cost",
        "Estimated_Labor_Hours", "Estimate_Date", "Employee_ID", "Employee_Name", "Employee_Role",
    )


def vw_estimate_employees(tables: Tables) -> DataFrame:
    """All estimates with their estimator, without labour hours and in no order."""
    return _with_people(tables, tables["Estimate"]).select(
        "Estimate_ID", "Estimate_Date", "Client_Name", "Property_Address", "Service_Description",
        "Estimated_Cost", "Employee_ID", "Employee_Name", "Employee_Role")


@listing("-Estimate_Date", "Estimate_ID")
def all_estimates(tables: Tables) -> DataFrame:
    """All estimates, newest first, with the ids of the client and the estimator."""
    return _with_people(tables, tables["Estimate"]).select(
        "Estimate_ID", "Client_Name", "Client_ID", "Property_Address", "Service_Description",
        "Estimated_Cost", "Estimated_Labor_Hours", "Estimate_Date", "Employee_ID", "Employee_Name",
        "Employee_Role",
    )


def estimate_by_id(tables: Tables, estimate_id: Any) -> DataFrame:
    """Estimates with the id or ids wanted; no id, no estimate."""
    rows = all_estimates(tables)
    return rows.limit(0) if is_open(estimate_id) else match_ids(rows, "Estimate_ID", estimate_id)


def filter_estimates(estimates: DataFrame, client_id: Any = None, employee_id: Any = None) -> DataFrame:
    return match_ids(match_ids(estimates, "Client_ID", client_id), "Employee_ID", employee_id)


def with_hourly_rate(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn(
        "Hourly_Rate", hourly_rate(F.col("Estimated_Cost"), F.col("Estimated_Labor_Hours")))


# The label shown where a column is NULL or empty.
LABELS = {"Employee_Name": "Unassigned", "Employee_Role": "No Role", "Status": "Pending"}


def fill_labels(rows: DataFrame) -> DataFrame:
    """Readable labels in place of missing names, roles and statuses."""
    return rows.withColumns({
        column: label_or(F.col(column), label) for column, label in LABELS.items() if column in rows.columns})


def contract_draft_from_estimates(estimates: DataFrame) -> DataFrame:
    """Contract submissions carrying over client, price and scope of each estimate."""
    return estimates.select(
        F.col("Estimate_ID").alias("estimate_id"),
        F.col("Client_ID").alias("client_id"),
        F.col("Estimated_Cost").alias("pricing"),
        F.col("Service_Description").alias("service_scope"),
    )
