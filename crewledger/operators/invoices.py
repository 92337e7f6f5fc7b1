"""Invoice listings, receivables aging, billing periods and payments of a month."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewledger.functions.dates import as_of_date, days_after, month_name
from crewledger.functions.money import balance, or_zero
from crewledger.functions.status import aging_bucket
from crewledger.operators.filters import apply_filters, match_ids, whole_number
from crewledger.operators.joins import lookup
from crewledger.operators.order import listing
from crewledger.sources.tables import STORED_YEAR, Tables, in_stored_period, in_stored_year

OPEN_STATUSES = ["Unpaid", "Partial"]


def _names(tables: Tables) -> DataFrame:
    return tables["Client"].select("Client_ID", "Client_Name")


def _balance_due() -> Column:
    return balance(F.col("Total_Amount"), F.col("Amount_Paid")).alias("Balance_Due")


CONTRACT_COLUMNS = ["Contract_ID", "Client_Name", "Pricing", "Service_Scope"]


def _named_contracts(tables: Tables) -> DataFrame:
    contracts = tables["Contract"].select("Contract_ID", "Client_ID", "Pricing", "Service_Scope")
    return contracts.join(_names(tables), "Client_ID")


@listing("-Contract_ID")
def contracts_list(tables: Tables) -> DataFrame:
    """Contracts with the client's name, latest first."""
    return _named_contracts(tables).select(CONTRACT_COLUMNS)


@listing("-Contract_ID")
def contracts_for_client(tables: Tables, name: str | None = None, client_id: Any = None) -> DataFrame:
    """Contracts of a client, by name or by id; names need not be unique."""
    named = apply_filters(_named_contracts(tables), {"Client_Name": name})
    return match_ids(named, "Client_ID", client_id).select(CONTRACT_COLUMNS)


@listing("-Invoice_Date", "Invoice_ID")
def invoices_by_client(tables: Tables, client_id: Any = None) -> DataFrame:
    """Invoices with their balance, newest first; `client_id` may be a DataFrame of ids."""
    return match_ids(tables["Invoice"], "Client_ID", client_id).select(
        "Invoice_ID", "Contract_ID", "Client_ID", "Total_Amount", "Amount_Paid", _balance_due(),
        "Invoice_Status", "Invoice_Date", "Due_Date",
    )


@listing("-Invoice_Date", "Invoice_ID")
def all_invoices(tables: Tables) -> DataFrame:
    """Every invoice with its client's name and balance, newest first."""
    return tables["Invoice"].join(_names(tables), "Client_ID").select(
        "Invoice_ID", "Contract_ID", "Client_ID", "Client_Name", "Invoice_Date", "Due_Date",
        "Total_Amount", "Amount_Paid", _balance_due(), "Invoice_Status",
    )


def filter_invoices(invoices: DataFrame, client_id: Any = None, status: str | None = None) -> DataFrame:
    return apply_filters(match_ids(invoices, "Client_ID", client_id), {"Invoice_Status": status})


def _in_month(rows: DataFrame, date: str, month: Any, year: Any) -> DataFrame:
    return in_stored_period(rows, date, whole_number(month), whole_number(year))


@listing("-Invoice_Date", "Invoice_ID")
def monthly_revenue(tables: Tables, month: Any = None, year: Any = None) -> DataFrame:
    """Every invoice dated in a period, newest first."""
    dated = _in_month(tables["Invoice"], "Invoice_Date", month, year)
    return dated.join(_names(tables), "Client_ID").select(
        "Invoice_ID", "Invoice_Date", "Due_Date", "Total_Amount", "Amount_Paid", _balance_due(),
        "Invoice_Status", "Client_Name",
        F.year("Invoice_Date").alias("Year"), F.month("Invoice_Date").alias("Month"),
    )


def _aged(invoices: DataFrame, as_of: str | datetime.date | None, scheme: str) -> DataFrame:
    days = days_after(as_of_date(as_of), F.col("Due_Date"))
    return (invoices.withColumn("Balance_Due", _balance_due()).withColumn("Days_Overdue", days)
            .withColumn("Aging_Bucket", aging_bucket(F.col("Days_Overdue"), scheme)))


@listing("-Days_Overdue", "Invoice_ID")
def outstanding_invoices(tables: Tables, as_of: str | datetime.date | None = None) -> DataFrame:
    """Unpaid and partly paid invoices in four age buckets, most overdue first."""
    unsettled = tables["Invoice"].filter(F.col("Invoice_Status").isin(OPEN_STATUSES))
    return _aged(unsettled.join(_names(tables), "Client_ID"), as_of, "short").select(
        "Invoice_ID", "Client_Name", "Client_ID", "Invoice_Date", "Due_Date", "Total_Amount",
        "Amount_Paid", "Balance_Due", "Invoice_Status", "Days_Overdue", "Aging_Bucket",
    )


@listing("-Days_Overdue", "Invoice_ID")
def vw_outstanding_invoices(tables: Tables, as_of: str | datetime.date | None = None) -> DataFrame:
    """Invoices in any status but Paid, five age buckets, with the client's e-mail address."""
    unsettled = (tables["Invoice"].filter(F.col("Invoice_Status") != "Paid")
                 .join(tables["Contract"].select("Contract_ID"), "Contract_ID", "left_semi"))
    clients = tables["Client"].select("Client_ID", "Client_Name", "Client_Email")
    return _aged(unsettled.join(clients, "Client_ID"), as_of, "long").select(
        "Invoice_ID", "Client_ID", "Client_Name", "Client_Email", "Invoice_Date", "Due_Date",
        "Total_Amount", "Amount_Paid", "Balance_Due", "Days_Overdue", "Aging_Bucket",
    )


def recent_outstanding(
    tables: Tables, as_of: str | datetime.date | None = None, first: int = 5
) -> DataFrame:
    """The `first` most overdue invoices and, on each row, how many more there are."""
    rows = outstanding_invoices(tables, as_of)
    count = rows.agg(F.count(F.lit(1))).scalar()
    return rows.select(
        "Invoice_ID", "Client_Name", "Balance_Due", "Days_Overdue", "Aging_Bucket",
    ).limit(first).withColumn("More_Count", F.greatest(count - first, F.lit(0)))


def days_overdue_clamped(invoices: DataFrame) -> DataFrame:
    """Days overdue as shown to a reader: never below 0, and 0 without a due date."""
    shown = F.greatest(F.coalesce(F.col("Days_Overdue"), F.lit(0)), F.lit(0))
    return invoices.withColumn("Days_Overdue", shown)


@listing("-Payment_Date", "Payment_ID")
def vw_payments_this_month(tables: Tables, as_of: str | datetime.date | None = None) -> DataFrame:
    """Payments dated in the month of `as_of`, newest first."""
    start = F.trunc(as_of_date(as_of), "month")
    paid = F.col("Payment_Date")
    payments = in_stored_year(tables["Payment"], F.year(start)).filter((paid >= start) & (paid < F.add_months(start, 1))).select(
        "Payment_ID", "Contract_ID", "Invoice_ID", "Payment_Amount", "Payment_Method",
        "Payment_Date", "Payment_Status",
    )
    # From the month's few payments outwards, so that contracts and clients are not joined in full.
    owned = payments.join(tables["Contract"].select("Contract_ID", "Client_ID"), "Contract_ID").join(_names(tables), "Client_ID")
    invoices = tables["Invoice"].select(
        "Invoice_ID", F.col("Invoice_ID").alias("Billed_ID"), F.col("Total_Amount").alias("Invoice_Total"))
    return lookup(owned, invoices, "Invoice_ID", "Payment_ID").select(
        "Payment_ID", "Client_Name", "Contract_ID", "Payment_Amount", "Payment_Method",
        "Payment_Date", "Payment_Status", F.col("Billed_ID").alias("Invoice_ID"), "Invoice_Total",
    )


def _period_key(month, year):
    return F.concat_ws(
        "-",
        F.coalesce(month.cast("string"), F.lit("all")),
        F.coalesce(year.cast("string"), F.lit("all")),
    )


def in_asked_years(invoices: DataFrame, asked: DataFrame) -> DataFrame:
    """The invoices that periods (Month, Year) may cover, by the folders they are stored in.

    Where every period names its year, only those years are listed; a period of any year needs all of them. The years
    come from a scalar subquery over the small table of periods, which prunes the folders while the query runs.
    Files without a stored year are always read.
    """
    if STORED_YEAR not in invoices.columns:
        return invoices
    # At most one entry per calendar year.
    wanted = asked.agg(F.struct(
        F.coalesce(F.bool_or(F.col("Year").isNull()), F.lit(False)).alias("all"), F.collect_set("Year").alias("years"))).scalar()
    year = F.col(STORED_YEAR)
    return invoices.filter(year.isNull() | wanted["all"] | F.array_contains(wanted["years"], year))


def period_totals(invoices: DataFrame, periods: DataFrame) -> DataFrame:
    """Invoice totals of each period asked for. Stored invoices of other years are not read (`in_asked_years`).

    `periods` has Month and Year; NULL in either means any. A period asked for twice counts once,
    periods may overlap, and a period without invoices has totals of 0. The invoices are reduced
    to one row per month before the months are rolled up to years, months of any year and all
    time, so the match with the periods is an equi-join of two small tables.
    """
    asked = periods.select(
        F.col("Month").cast("int").alias("Month"), F.col("Year").cast("int").alias("Year")).distinct()
    by_month = in_asked_years(invoices, asked).groupBy(
        F.month("Invoice_Date").alias("Month"), F.year("Invoice_Date").alias("Year"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Total_Amount").alias("billed"), F.sum("Amount_Paid").alias("paid"),
    )
    rolled = by_month.cube("Month", "Year").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"),
        F.sum("billed").alias("billed"), F.sum("paid").alias("paid"),
    )
    # A NULL that stands for "any" comes with its bit set in the level; an undated invoice's does not.
    any_month = F.col("level").bitwiseAND(2) != 0
    any_year = F.col("level").bitwiseAND(1) != 0
    rolled = rolled.filter((any_month | F.col("Month").isNotNull()) & (any_year | F.col("Year").isNotNull()))
    sums = rolled.select(_period_key(F.col("Month"), F.col("Year")).alias("Period"), "n", "billed", "paid")
    asked = asked.withColumn("Period", _period_key(F.col("Month"), F.col("Year")))
    return asked.join(sums, "Period", "left").select(
        "Period", "Month", "Year", month_name(F.col("Month")).alias("Month_Name"),
        F.coalesce("n", F.lit(0)).alias("Invoice_Count"),
        or_zero(F.col("billed")).alias("Total_Billed"),
        or_zero(F.col("paid")).alias("Total_Collected"),
        (or_zero(F.col("billed")) - or_zero(F.col("paid"))).alias("Total_Outstanding"),
    )


def grand_total(period_rows: DataFrame) -> DataFrame:
    """Sum over all periods; an invoice counts once for every period that covers it."""
    return period_rows.agg(
        F.count(F.lit(1)).alias("Period_Count"),
        F.coalesce(F.sum("Invoice_Count"), F.lit(0)).alias("Invoice_Count"),
        or_zero(F.sum("Total_Billed")).alias("Total_Billed"),
        or_zero(F.sum("Total_Collected")).alias("Total_Collected"),
    ).withColumn("Total_Outstanding", F.col("Total_Billed") - F.col("Total_Collected"))


def monthly_chart(invoices: DataFrame, height: int = 140, least: int = 4) -> DataFrame:
    """Billed and invoice count per month with a bar height scaled to the largest month."""
    by_month = invoices.groupBy(
        F.year("Invoice_Date").alias("Year"), F.month("Invoice_Date").alias("Month"),
    ).agg(F.count(F.lit(1)).alias("Invoice_Count"), or_zero(F.sum("Total_Amount")).alias("Total_Billed"))
    # One row per month remains here, so a window over all of them is small.
    largest = F.greatest(F.max("Total_Billed").over(Window.partitionBy()), F.lit(1))
    bar = F.round(F.col("Total_Billed") * height / largest, 0).cast("int")
    return by_month.withColumn("Bar_Height", F.greatest(bar, F.lit(least))).orderBy("Year", "Month")

