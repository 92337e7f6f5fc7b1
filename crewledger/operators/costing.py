"""Job costing: estimated against actual cost."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewledger.functions.status import budget_status
from crewledger.operators.filters import match_ids, whole_number
from crewledger.operators.order import listing
from crewledger.sources.tables import Tables, in_stored_period, with_virtual


def _jobs(tables: Tables, services: DataFrame, costs: DataFrame) -> DataFrame:
    served = services.select("Service_ID", "Client_ID", "Service_Type", "Service_Date", "Property_Location")
    return (with_virtual(costs).join(served, "Service_ID")
            .join(tables["Client"].select("Client_ID", "Client_Name"), "Client_ID")
            .withColumn("Budget_Status", budget_status(F.col("Variance"))))


SHOWN = [
    "Job_Cost_ID", "Estimate_ID", "Service_ID", "Service_Type", "Service_Date", "Client_Name", "Property_Location",
    "Total_Estimated_Cost", "Total_Actual_Cost", "Actual_Labor_Hours", "Actual_Labor_Cost", "Actual_Materials", "Variance", "Budget_Status",
]


@listing("-Service_Date", "Job_Cost_ID")
def job_costing(
    tables: Tables, estimate_id: Any = None, month: Any = None, year: Any = None
) -> DataFrame:
    """Job-cost rows with variance and status, and on each the totals of all rows shown.

    The totals come from one scalar subquery: partial sums in parallel, one row to the driver. A
    window over everything would move all rows to one task.
    """
    services = in_stored_period(tables["Service"], "Service_Date", whole_number(month), whole_number(year))
    jobs = _jobs(tables, services, match_ids(tables["Job_Costing"], "Estimate_ID", estimate_id))
    # The totals are taken of the same rows with all their columns, so that both share the exchanges below the joins:
    # with fewer columns the tables would be read and moved once more. The checksum only keeps the columns.
    totals = jobs.agg(F.struct(
        F.sum("Total_Actual_Cost").alias("actual"), F.sum("Total_Estimated_Cost").alias("estimated"),
        F.bit_xor(F.xxhash64(*SHOWN)).alias("checksum"))).scalar()
    return jobs.withColumn("_totals", totals).select(
        *SHOWN, F.col("_totals.actual").alias("Grand_Total_Actual"), F.col("_totals.estimated").alias("Grand_Total_Estimated"))


@listing("-Service_Date", "Job_Cost_ID")
def vw_job_costing(tables: Tables) -> DataFrame:
    """Job-cost rows with variance and status, without estimate and totals."""
    return _jobs(tables, tables["Service"], tables["Job_Costing"]).select(
        "Job_Cost_ID", "Service_ID", "Service_Type", "Service_Date", "Client_Name",
        "Property_Location", "Total_Estimated_Cost", "Total_Actual_Cost", "Actual_Labor_Hours",
        "Actual_Labor_Cost", "Actual_Materials", "Variance", "Budget_Status",
    )
