"""Client look-ups, ranking, feedback, referrals and service histories."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crewledger.functions.text import contains_ignoring_case, like_ignoring_case
from crewledger.operators.filters import apply_filters, is_open, match_ids
from crewledger.operators.joins import childless, lookup, presence, with_childless
from crewledger.operators.order import listing, with_positions
from crewledger.operators.quality import Checked, check_foreign_key
from crewledger.operators.revenue import client_revenue, top_clients
from crewledger.sources.tables import Tables


@listing("Client_Name", "Client_ID")
def clients_list(tables: Tables) -> DataFrame:
    return tables["Client"].select("Client_ID", "Client_Name")


@listing("Client_Name", "Client_ID")
def clients_full(tables: Tables) -> DataFrame:
    return tables["Client"].select(
        "Client_ID", "Client_Name", "Client_Phone", "Client_Email", "Property_Address",
    )


def client_by_id(tables: Tables, client_id: Any) -> DataFrame:
    """Clients with the id or ids wanted; no id, no client."""
    wanted = tables["Client"].limit(0) if is_open(client_id) else match_ids(tables["Client"], "Client_ID", client_id)
    return wanted.select("Client_ID", "Client_Name", "Client_Phone", "Client_Email", "Property_Address")


def client_exists(
    tables: Tables, rows: DataFrame, column: str = "Client_ID", row_key: str = "submission_id"
) -> Checked:
    """The rows that name an existing client, and the others with a reason."""
    return check_foreign_key(rows, column, tables["Client"], row_key)


# Rows of a top list that one task ranks; longer lists are ranked by ranges.
MOST_IN_ONE_TASK = 10_000


def rank_clients(
    tables: Tables, limit: int | str = 10, client_id: Any = None, keep_global_rank: bool = False
) -> DataFrame:
    """Top clients with ranks from 1.

    Ranks are given to the rows shown, so a single client asked for ranks 1; `keep_global_rank`
    gives that client its rank among all rows instead.
    """
    order = [F.desc("Total_Collected"), F.asc("Client_ID")]
    if int(limit) > MOST_IN_ONE_TASK:
        # Ranks from ranges of the order: neither a limit nor a window brings the rows together.
        revenue = client_revenue(tables)
        if keep_global_rank or is_open(client_id):
            ranked = with_positions(revenue, *order, name="Rank").filter(F.col("Rank") <= int(limit))
            return match_ids(ranked, "Client_ID", client_id)
        shown = with_positions(revenue, *order, name="_place").filter(F.col("_place") <= int(limit)).drop("_place")
        return with_positions(match_ids(shown, "Client_ID", client_id), *order, name="Rank")
    best = top_clients(tables, limit)
    rank = F.row_number().over(Window.orderBy(*order))
    if keep_global_rank:
        return match_ids(best.withColumn("Rank", rank), "Client_ID", client_id)
    return match_ids(best, "Client_ID", client_id).withColumn("Rank", rank)


@listing("-Feedback_Date", "Feedback_ID")
def client_feedback(tables: Tables, client_id: Any = None, rating: Any = None) -> DataFrame:
    """Feedback that names a known service, newest first."""
    wanted = apply_filters(match_ids(tables["Client_Feedback"], "Client_ID", client_id), {"Rating": rating})
    return (wanted.join(tables["Client"].select("Client_ID", "Client_Name"), "Client_ID")
            .join(tables["Service"].select("Service_ID", "Service_Type", "Service_Date"), "Service_ID")
            .select("Feedback_ID", "Client_ID", "Client_Name", "Service_Type", "Service_Date", "Rating",
                    "Comments", "Suggestions", "Feedback_Date"))


@listing("-Feedback_Date", "Feedback_ID")
def vw_client_feedback(tables: Tables) -> DataFrame:
    """All feedback, with its service where there is one."""
    named = tables["Client_Feedback"].join(tables["Client"].select("Client_ID", "Client_Name"), "Client_ID")
    services = tables["Service"].select(
        "Service_ID", F.col("Service_ID").alias("Known_Service_ID"), "Service_Type")
    return lookup(named, services, "Service_ID", "Feedback_ID").select(
        "Feedback_ID", "Client_ID", "Client_Name", F.col("Known_Service_ID").alias("Service_ID"),
        "Service_Type", "Rating", "Comments", "Suggestions", "Feedback_Date",
    )


@listing("-Referral_Date", "Referral_ID")
def referrals(tables: Tables, referrer_id: Any = None) -> DataFrame:
    """Referrals with the names of the referrer and, once known as a client, of the referee."""
    clients = tables["Client"]
    referrers = clients.select(
        F.col("Client_ID").alias("Referrer_ID"), F.col("Client_Name").alias("Referrer_Name"))
    referees = clients.select(
        F.col("Client_ID").alias("Referee_ID"), F.col("Client_Name").alias("Referee_Client_Name"))
    wanted = match_ids(tables["Referral"], "Referrer_ID", referrer_id)
    named = lookup(wanted, referrers, "Referrer_ID", "Referral_ID")
    return lookup(named, referees, "Referee_ID", "Referral_ID").select(
        "Referral_ID", "Referee_Name", "Referrer_ID", "Referrer_Name", "Referee_ID",
        "Referee_Client_Name", "Referral_Date", "Status",
    )


def filter_referrals(rows: DataFrame, name: str | None = None) -> DataFrame:
    """Referrals whose referee name contains the text, in any case."""
    part = (name or "").strip()
    return rows.filter(contains_ignoring_case(F.col("Referee_Name"), part)) if part else rows


def referral_order(rows: DataFrame, column: str = "Referral_Date", ascending: bool = False) -> list[Column]:
    """Text sorts without case and NULL as empty text, a number sorts with NULL as 0."""
    kind = rows.schema[column].dataType
    key = F.col(column)
    if isinstance(kind, T.StringType):
        key = F.lower(F.coalesce(key, F.lit("")))
    elif isinstance(kind, T.NumericType):
        key = F.coalesce(key, F.lit(0))
    return [key.asc() if ascending else key.desc(), F.asc("Referral_ID")]


def sort_referrals(rows: DataFrame, column: str = "Referral_Date", ascending: bool = False) -> DataFrame:
    """Referrals by a column of the reader's choice, see `referral_order`."""
    return rows.orderBy(*referral_order(rows, column, ascending))


@listing("Client_Name", "-Service_Date", "Service_ID", "Invoice_ID")
def client_service_history(tables: Tables, client_id: Any = None, location: str | None = None) -> DataFrame:
    """Services of a client with the invoices of their contract, by client name, latest first.

    The listing has one row for every service and invoice of a contract.
    """
    services = match_ids(tables["Service"], "Client_ID", client_id)
    if not is_open(location):
        services = services.filter(like_ignoring_case(F.col("Property_Location"), location))
    clients = tables["Client"].select("Client_ID", "Client_Name", "Client_Phone", "Client_Email")
    contracts = tables["Contract"].select("Contract_ID", F.col("Pricing").alias("Contract_Price"))
    invoices = tables["Invoice"].select(
        "Contract_ID", "Invoice_ID", "Invoice_Status", "Total_Amount", "Amount_Paid")
    return (services.join(clients, "Client_ID").join(contracts, "Contract_ID").join(invoices, "Contract_ID")
            .select("Client_ID", "Client_Name", "Client_Phone", "Client_Email", "Service_ID",
                    "Service_Date", "Service_Type", "Property_Location", "Contract_ID",
                    "Contract_Price", "Invoice_ID", "Invoice_Status", "Total_Amount", "Amount_Paid"))


@listing("Client_Name", "Client_ID", "Contract_ID", "Entry_Date", "Entry_Kind", "Entry_ID")
def client_history_entries(tables: Tables, client_id: Any = None, location: str | None = None) -> DataFrame:
    """The same history, one row for each service, invoice and payment.

    `client_service_history` pairs every service of a contract with every invoice, so n services and m invoices
    make n * m rows; here they make n + m, and the contract's payments come with them. The rows are those of the services, contracts
    and invoices that occur in the pairs: a contract without invoices has no entries. A contract that serves
    several clients has its invoices and payments listed for each.
    """
    services = match_ids(tables["Service"], "Client_ID", client_id)
    if not is_open(location):
        services = services.filter(like_ignoring_case(F.col("Property_Location"), location))
    contracts = tables["Contract"].select("Contract_ID").join(tables["Invoice"].select("Contract_ID"), "Contract_ID", "left_semi")
    clients = tables["Client"].select("Client_ID", "Client_Name")
    listed = services.filter(F.col("Contract_ID").isNotNull()).join(contracts, "Contract_ID", "left_semi")
    # One row for each client and contract: a hot contract meets its invoices once per client.
    owners = listed.select("Client_ID", "Contract_ID").distinct()

    def entries(rows: DataFrame, kind: str, key: str, date: str, detail: str, amount: Column) -> DataFrame:
        return rows.select(
            "Client_ID", "Contract_ID", F.lit(kind).alias("Entry_Kind"), F.col(key).alias("Entry_ID"), F.col(date).alias("Entry_Date"),
            F.col(detail).alias("Detail"), amount.cast("decimal(10,2)").alias("Amount"))

    def owned(table: str) -> DataFrame:
        return tables[table].drop("Client_ID").join(owners, "Contract_ID")

    return (entries(listed, "service", "Service_ID", "Service_Date", "Service_Type", F.lit(None))
            .unionAll(entries(owned("Invoice"), "invoice", "Invoice_ID", "Invoice_Date", "Invoice_Status", F.col("Total_Amount")))
            .unionAll(entries(owned("Payment"), "payment", "Payment_ID", "Payment_Date", "Payment_Method", F.col("Payment_Amount")))
            .join(clients, "Client_ID"))


@listing(
    "Client_Name", "-Service_Date", "Client_ID", "Estimate_ID", "Contract_ID", "Service_ID", "Invoice_ID", "Payment_ID",
)
def vw_client_service_history(tables: Tables) -> DataFrame:
    """Every client with all estimates, contracts, services, invoices and payments.

    Parents without children stay, with NULLs. See `with_childless` for the form of the joins. Every table is read twice: for
    its rows, and for the keys that tell which parents have children.
    """
    clients = tables["Client"].select("Client_ID", "Client_Name", "Property_Address")
    estimates = tables["Estimate"].select("Client_ID", "Estimate_ID", "Estimate_Date", "Estimated_Cost")
    contracts = tables["Contract"].select(
        "Estimate_ID", "Contract_ID", "Contract_StartDate", "Contract_EndDate")
    services = tables["Service"].select(
        "Contract_ID", "Service_ID", "Service_Type", "Service_Date", "Property_Location")
    invoices = tables["Invoice"].select("Contract_ID", "Invoice_ID", "Total_Amount", "Invoice_Status")
    payments = tables["Payment"].select("Invoice_ID", "Payment_ID", "Payment_Amount", "Payment_Date")

    # Fixed bits: the columns in which a key may occur.
    paid_invoice, invoice, served, billed, contract, contracted, estimate, estimated_for, client = (1 << n for n in range(9))
    present = presence([
        (tables["Payment"], {"Invoice_ID": paid_invoice}),
        (tables["Invoice"], {"Invoice_ID": invoice, "Contract_ID": billed}),
        (tables["Service"], {"Contract_ID": served}),
        (tables["Contract"], {"Contract_ID": contract, "Estimate_ID": contracted}),
        (tables["Estimate"], {"Estimate_ID": estimate, "Client_ID": estimated_for}),
        (tables["Client"], {"Client_ID": client}),
    ])
    unpaid, unserved = childless(present, invoice, paid_invoice, "Invoice_ID"), childless(present, contract, served, "Contract_ID")
    unbilled, uncontracted = childless(present, contract, billed, "Contract_ID"), childless(present, estimate, contracted, "Estimate_ID")
    paid = invoices.join(with_childless(payments, unpaid, "Invoice_ID"), "Invoice_ID")
    under_contract = (contracts
                      .join(with_childless(services, unserved, "Contract_ID"), "Contract_ID")
                      .join(with_childless(paid, unbilled, "Contract_ID"), "Contract_ID"))
    estimated = estimates.join(with_childless(under_contract, uncontracted, "Estimate_ID"), "Estimate_ID")
    unestimated = childless(present, client, estimated_for, "Client_ID")
    return (clients.join(with_childless(estimated, unestimated, "Client_ID"), "Client_ID")
            .select("Client_ID", "Client_Name", "Property_Address", "Estimate_ID", "Estimate_Date",
                    "Estimated_Cost", "Contract_ID", "Contract_StartDate", "Contract_EndDate",
                    "Service_ID", "Service_Type", "Service_Date", "Property_Location", "Invoice_ID",
                    "Total_Amount", "Invoice_Status", "Payment_ID", "Payment_Amount", "Payment_Date"))
