"""Totals over the rows of any listing. Sums are exact decimals and 0 over no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewledger.functions.money import or_zero

ROW_KIND = "Row_Kind"


def sum_or_zero(column: str) -> Column:
    return or_zero(F.sum(column))


def invoice_totals(invoices: DataFrame) -> DataFrame:
    """Count, billed, collected and outstanding of a set of invoices."""
    return invoices.agg(
        F.count(F.lit(1)).alias("Invoice_Count"),
        sum_or_zero("Total_Amount").alias("Total_Billed"),
        sum_or_zero("Amount_Paid").alias("Total_Collected"),
    ).withColumn("Total_Outstanding", F.col("Total_Billed") - F.col("Total_Collected"))


def estimate_totals(estimates: DataFrame) -> DataFrame:
    """Count, cost, hours and mean cost of a set of estimates; the mean of none is 0."""
    count = F.col("Estimate_Count")
    return estimates.agg(
        F.count(F.lit(1)).alias("Estimate_Count"),
        sum_or_zero("Estimated_Cost").alias("Total_Cost"),
        sum_or_zero("Estimated_Labor_Hours").alias("Total_Hours"),
    ).withColumn(
        "Avg_Cost",
        F.when(count > 0, F.col("Total_Cost") / F.nullif(count, F.lit(0)).cast("decimal(20,0)"))
        .otherwise(F.lit(0)).cast("decimal(14,6)"),
    )


def service_totals(services: DataFrame) -> DataFrame:
    """Rows, rows with a description, and distinct clients of a set of services."""
    return services.agg(
        F.count(F.lit(1)).alias("Total_Services"),
        F.count_if(F.col("Service_Description") != "").alias("With_Description"),
        F.count_distinct("Client_ID").alias("Unique_Clients"),
    )


def job_cost_totals(jobs: DataFrame) -> DataFrame:
    """Rows, estimated, actual and variance of a set of job-cost rows."""
    return jobs.agg(
        F.count(F.lit(1)).alias("Record_Count"),
        sum_or_zero("Total_Estimated_Cost").alias("Total_Estimated"),
        sum_or_zero("Total_Actual_Cost").alias("Total_Actual"),
    ).withColumn("Total_Variance", F.col("Total_Actual") - F.col("Total_Estimated"))


def with_total_row(rows: DataFrame, sums: list[str]) -> DataFrame:
    """The rows plus one total row, told apart by `Row_Kind`; `Row_Count` is set on the total only.

    The detail rows pass through without a shuffle; only partial sums travel.
    """
    total = rows.agg(F.count(F.lit(1)).alias("Row_Count"), *[sum_or_zero(c).alias(c) for c in sums])
    detail = rows.withColumn("Row_Count", F.lit(None).cast("bigint")).withColumn(ROW_KIND, F.lit("detail"))
    return detail.unionByName(total.withColumn(ROW_KIND, F.lit("total")), allowMissingColumns=True)
