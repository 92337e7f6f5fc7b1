"""Revenue by service type, location and month, and the dashboard figures.

Services and invoices both hang off a contract, and the reports add up an invoice once for every
service of its contract. That sum is computed without forming the service-invoice pairs: invoices
are reduced to one row per contract, services to one row per contract and report group, and a
group's sum is its number of services times the contract's sum. Both reductions combine on the map
side, so a contract with a third of all invoices and services reaches the join as a few rows. The
report by month, whose keys few services share, reduces the invoices only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewledger.functions.money import average, or_zero
from crewledger.operators.filters import apply_filters
from crewledger.operators.invoices import OPEN_STATUSES
from crewledger.operators.order import listing
from crewledger.sources.tables import Tables


def _billed_contracts(tables: Tables) -> DataFrame:
    """One row per existing contract that has invoices, with the sums over them."""
    sums = tables["Invoice"].groupBy("Contract_ID").agg(
        F.count(F.lit(1)).alias("invoices"),
        F.count("Total_Amount").alias("amounts"),
        F.sum("Total_Amount").alias("billed"),
        F.sum("Amount_Paid").alias("received"),
    )
    return sums.join(tables["Contract"].select("Contract_ID"), "Contract_ID", "left_semi")


def without_case(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with a collation under which `North Lane` and `north lane` are one group."""
    return rows.withColumns({c: F.collate(F.col(c), "UTF8_LCASE") for c in columns})


def _billed_groups(tables: Tables, services: DataFrame, keys: list[str], dedupe: bool, distinct: bool = False) -> DataFrame:
    """One row per contract and report group beside the contract's invoice sums.

    `weight` is how often each invoice of the contract counts in the group. `services` counts rows; with `distinct` there is
    `distinct_services` as well, which counts a service once however often it is stored.
    """
    rows = services.filter(F.col("Contract_ID").isNotNull())
    dates = [F.min("Service_Date").alias("first"), F.max("Service_Date").alias("last")]
    if distinct:
        once = rows.groupBy("Contract_ID", *keys, "Service_ID").agg(F.count(F.lit(1)).alias("services"), *dates)
        groups = once.groupBy("Contract_ID", *keys).agg(
            F.sum("services").alias("services"), F.count("Service_ID").alias("distinct_services"), F.min("first").alias("first"), F.max("last").alias("last"))
    else:
        groups = rows.groupBy("Contract_ID", *keys).agg(F.count(F.lit(1)).alias("services"), *dates)
    weight = F.lit(1).cast("bigint") if dedupe else F.col("services")
    return groups.withColumn("weight", weight).join(_billed_contracts(tables), "Contract_ID")


def _weighted_sum(column: str) -> Column:
    # A per-contract sum has 20 digits and a weight 14; their sum needs the widest decimal.
    return F.sum(F.col(column) * F.col("weight").cast("decimal(14,0)")).cast("decimal(38,2)")


def _weighted_mean() -> Column:
    return average(_weighted_sum("billed"), F.sum(F.col("amounts") * F.col("weight")))


def revenue_by_service(
    tables: Tables, service_type: str | None = None, dedupe_invoices: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Services, revenue, mean invoice and first and latest date per service type.

    A service counts once. With `dedupe_invoices` an invoice counts once per type as well.
    `ignore_case` takes types that differ in case only for one, here and in the other reports.
    """
    services = tables["Service"]
    if ignore_case:
        services = without_case(services, ["Service_Type"])
    services = apply_filters(services, {"Service_Type": service_type})
    rows = _billed_groups(tables, services, ["Service_Type"], dedupe_invoices, distinct=True)
    return rows.groupBy("Service_Type").agg(
        F.sum("distinct_services").alias("Total_Services"),
        _weighted_sum("billed").alias("Total_Revenue"),
        _weighted_mean().alias("Avg_Revenue"),
        F.min("first").alias("First_Service"),
        F.max("last").alias("Latest_Service"),
    ).orderBy(F.desc("Total_Revenue"), "Service_Type")


@listing("-Total_Revenue", "Service_Type")
def vw_revenue_by_service_type(
    tables: Tables, dedupe_invoices: bool = False, ignore_case: bool = False
) -> DataFrame:
    """As above, but a service counts once for every invoice of its contract."""
    services = without_case(tables["Service"], ["Service_Type"]) if ignore_case else tables["Service"]
    rows = _billed_groups(tables, services, ["Service_Type"], dedupe_invoices)
    return rows.groupBy("Service_Type").agg(
        F.sum(F.col("services") * F.col("invoices")).alias("Total_Services"),
        _weighted_sum("billed").alias("Total_Revenue"),
        _weighted_mean().alias("Avg_Revenue_Per_Service"),
        F.min("first").alias("Earliest_Service"),
        F.max("last").alias("Latest_Service"),
    )


@listing("-Total_Revenue", "Property_Location")
def vw_revenue_by_location(
    tables: Tables, dedupe_invoices: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Services, revenue and mean invoice per property location; unknown locations are left out."""
    located = tables["Service"].filter(F.col("Property_Location").isNotNull())
    if ignore_case:
        located = without_case(located, ["Property_Location"])
    rows = _billed_groups(tables, located, ["Property_Location"], dedupe_invoices)
    return rows.groupBy("Property_Location").agg(
        F.sum(F.col("services") * F.col("invoices")).alias("Total_Services"),
        _weighted_sum("billed").alias("Total_Revenue"),
        _weighted_mean().alias("Avg_Revenue"),
    )


@listing("-Revenue_Year", "-Revenue_Month", "Service_Type", "Client_Name", "Property_Location")
def vw_monthly_revenue_report(
    tables: Tables, dedupe_invoices: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Revenue by month of service, service type, client name and location.

    Few services of a contract share all of these, so they meet the contract's sums one by one; only with
    `dedupe_invoices` are they reduced per contract before.
    """
    keys = ["Revenue_Year", "Revenue_Month", "Service_Type", "Client_Name", "Property_Location"]
    services = tables["Service"].withColumns({
        "Revenue_Year": F.year("Service_Date"), "Revenue_Month": F.month("Service_Date")})
    clients = tables["Client"].select("Client_ID", "Client_Name")
    if ignore_case:
        services, clients = without_case(services, [keys[2], keys[4]]), without_case(clients, [keys[3]])
    if dedupe_invoices:
        rows = _billed_groups(tables, services.join(clients, "Client_ID"), keys, True)
    else:
        one = F.lit(1).cast("bigint")
        rows = (services.filter(F.col("Contract_ID").isNotNull()).join(_billed_contracts(tables), "Contract_ID")
                .join(clients, "Client_ID").withColumns({"services": one, "weight": one}))
    return rows.groupBy(keys).agg(
        _weighted_sum("billed").alias("Total_Revenue"),
        _weighted_sum("received").alias("Total_Received"),
        F.sum(F.col("services") * F.col("invoices")).alias("Services_Rendered"),
    )


def _wide_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,2)"))


def _client_revenue(tables: Tables) -> DataFrame:
    """Contracts with invoices, billed, collected and outstanding, one row per client id."""
    invoices = tables["Invoice"].groupBy("Contract_ID").agg(
        F.sum("Total_Amount").alias("billed"), F.sum("Amount_Paid").alias("received"))
    contracts = tables["Contract"].select("Contract_ID", "Client_ID")
    # A contract stored twice adds its invoices twice, but counts once.
    per_contract = contracts.join(invoices, "Contract_ID").groupBy("Client_ID", "Contract_ID").agg(
        _wide_sum("billed").alias("billed"), _wide_sum("received").alias("received"))
    return per_contract.groupBy("Client_ID").agg(
        F.count(F.lit(1)).alias("Total_Contracts"),
        _wide_sum("billed").alias("Total_Billed"),
        _wide_sum("received").alias("Total_Collected"),
    ).withColumn("Outstanding_Balance", F.col("Total_Billed") - F.col("Total_Collected"))


REVENUE_COLUMNS = ["Total_Contracts", "Total_Billed", "Total_Collected", "Outstanding_Balance"]


def client_revenue(tables: Tables) -> DataFrame:
    """Every client with invoices by name, in no order."""
    clients = tables["Client"].select("Client_ID", "Client_Name")
    return clients.join(_client_revenue(tables), "Client_ID").select("Client_ID", "Client_Name", *REVENUE_COLUMNS)


def top_clients(tables: Tables, limit: int | str = 10) -> DataFrame:
    """The clients that paid most; equal sums are ordered by client id."""
    return (client_revenue(tables)
            .orderBy(F.desc("Total_Collected"), "Client_ID").limit(int(limit)))


@listing("-Total_Collected", "Client_ID")
def vw_top_clients_by_revenue(tables: Tables) -> DataFrame:
    """Every client with invoices, the one that paid most first, with contact details."""
    clients = tables["Client"].select("Client_ID", "Client_Name", "Client_Email", "Client_Phone")
    return (clients.join(_client_revenue(tables), "Client_ID")
            .select("Client_ID", "Client_Name", "Client_Email", "Client_Phone", *REVENUE_COLUMNS))


def dashboard_stats(tables: Tables) -> DataFrame:
    """Clients, contracts, open invoices and total invoiced, as one row. Invoices are read once."""
    invoices = tables["Invoice"].agg(
        F.count_if(F.col("Invoice_Status").isin(OPEN_STATUSES)).alias("Open_Invoices"),
        or_zero(F.sum("Total_Amount")).alias("Total_Invoiced"),
    )
    rows = F.count(F.lit(1))
    return invoices.select(
        tables["Client"].agg(rows).scalar().alias("Clients"),
        tables["Contract"].agg(rows).scalar().alias("Contracts"),
        "Open_Invoices", "Total_Invoiced",
    )
