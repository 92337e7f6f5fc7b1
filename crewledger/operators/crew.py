"""Employees: look-ups, availability, schedule and the clients each has served."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewledger.functions.dates import as_of_date
from crewledger.functions.status import schedule_status
from crewledger.operators.filters import is_open, match_ids
from crewledger.operators.joins import lookup
from crewledger.operators.order import listing
from crewledger.sources.tables import Tables

PUBLIC_COLUMNS = ["Employee_ID", "Employee_Name", "Employee_Role", "Is_Available"]


@listing("Employee_Name", "Employee_ID")
def employees_list(tables: Tables) -> DataFrame:
    return tables["Employee"].select(
        "Employee_ID", "Employee_Name", "Employee_Role")


def employee_count(tables: Tables) -> DataFrame:
    return tables["Employee"].agg(F.count(F.lit(1)).alias("Employee_Count"))


def employee_lookup(tables: Tables, employee_id: Any) -> DataFrame:
    """The employee with an id, at most one row; no id finds nobody."""
    found = tables["Employee"].limit(0) if is_open(employee_id) else match_ids(
        tables["Employee"], "Employee_ID", employee_id)
    return found.select(PUBLIC_COLUMNS).limit(1)


def employee_lookups(tables: Tables, wanted: DataFrame) -> DataFrame:
    """One row for every distinct id asked for (first column), with a Found flag."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("Employee_ID")).distinct()
    known = tables["Employee"].select(*PUBLIC_COLUMNS, F.lit(True).alias("Known"))
    return lookup(ids, known, "Employee_ID", "Employee_ID").select(
        *PUBLIC_COLUMNS, F.coalesce("Known", F.lit(False)).alias("Found"))


@listing("Employee_Name", "Employee_ID")
def service_employees(tables: Tables) -> DataFrame:
    """Employees available for a job, with their contact details."""
    return tables["Employee"].filter(F.col("Is_Available") == 1).select(
        "Employee_ID", "Employee_Name", "Employee_Role", "Employee_Phone", "Employee_Email",
        "Is_Available",
    )


@listing("Employee_Name", "Employee_ID")
def vw_service_employees(tables: Tables) -> DataFrame:
    """As above, without the e-mail address."""
    return service_employees(tables, ordered=False).drop("Employee_Email")


@listing("Service_Date", "Service_ID", "Employee_Name")
def schedule_workload(tables: Tables, as_of: str | datetime.date | None = None) -> DataFrame:
    """Services with the employees assigned, oldest first, marked Completed, Today or Upcoming."""
    crews = tables["Service_Employee"].join(
        tables["Employee"].select("Employee_ID", "Employee_Name", "Employee_Role"), "Employee_ID")
    services = tables["Service"].select(
        "Service_ID", "Client_ID", "Service_Date", "Service_Type", "Property_Location")
    clients = tables["Client"].select("Client_ID", "Client_Name")
    return (services.join(clients, "Client_ID").join(crews, "Service_ID")
            .withColumn("Status", schedule_status(F.col("Service_Date"), as_of_date(as_of)))
            .select("Service_ID", "Service_Date", "Service_Type", "Client_Name", "Property_Location",
                    "Employee_Name", "Employee_Role", "Status"))


def employee_clients(tables: Tables) -> DataFrame:
    """Each client an employee has served: last date, number of services, greatest description.

    Services count once, however often a service or an assignment is stored. Rows are reduced to
    one per employee and client before names and addresses join.
    """
    services = tables["Service"].select("Service_ID", "Client_ID", "Service_Date", "Service_Description")
    served = (tables["Service_Employee"].join(services, "Service_ID")
              .groupBy("Employee_ID", "Client_ID", "Service_ID").agg(
                  F.max("Service_Date").alias("Service_Date"), F.max("Service_Description").alias("Service_Description"))
              .groupBy("Employee_ID", "Client_ID").agg(
                  F.max("Service_Date").alias("Last_Service_Date"),
                  F.count(F.lit(1)).alias("Times_Served"),
                  F.max("Service_Description").alias("Last_Description")))
    employees = tables["Employee"].select("Employee_ID", "Employee_Name")
    clients = tables["Client"].select(
        "Client_ID", "Client_Name", "Client_Phone", "Client_Email", "Property_Address")
    return served.join(employees, "Employee_ID").join(clients, "Client_ID").select(
        "Employee_ID", "Employee_Name", "Client_ID", "Client_Name", "Client_Phone", "Client_Email",
        "Property_Address", "Last_Service_Date", "Times_Served", "Last_Description")


@listing("-Last_Service_Date", "Client_ID")
def my_clients(tables: Tables, employee_id: Any) -> DataFrame:
    """The clients of one employee (or of a DataFrame of ids), the latest served first."""
    rows = employee_clients(tables)
    mine = rows.limit(0) if is_open(employee_id) else match_ids(rows, "Employee_ID", employee_id)
    shown = ["Client_ID", "Client_Name", "Client_Phone", "Client_Email", "Property_Address",
             "Last_Service_Date", "Times_Served", "Last_Description"]
    if isinstance(employee_id, DataFrame):
        shown.insert(0, "Employee_ID")
    return mine.select(shown)
