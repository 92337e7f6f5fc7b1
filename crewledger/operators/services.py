"""Service look-ups and the services report."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewledger.functions.text import contains_ignoring_case
from crewledger.operators.filters import is_open, match_ids
from crewledger.operators.order import listing
from crewledger.sources.tables import Tables


@listing("-Service_Date", "Service_ID")
def services_by_client(tables: Tables, client_id: Any) -> DataFrame:
    """Services of a client, newest first; no id, no services. Takes a DataFrame of ids as well."""
    services = tables["Service"]
    wanted = services.limit(0) if is_open(client_id) else match_ids(services, "Client_ID", client_id)
    shown = ["Service_ID", "Service_Type", "Service_Date"]
    if isinstance(client_id, DataFrame):
        shown.insert(0, "Client_ID")
    return wanted.select(shown)


def service_types(tables: Tables) -> DataFrame:
    return tables["Service"].select("Service_Type").distinct().orderBy("Service_Type")


def services_report(
    tables: Tables,
    client_id: Any = None,
    description: str | None = None,
    date_from: str | datetime.date | None = None,
    date_to: str | datetime.date | None = None,
) -> DataFrame:
    """Services by client, text in the description and first and last day, both included."""
    rows = match_ids(tables["Service"], "Client_ID", client_id)
    part = (description or "").strip()
    if part:
        rows = rows.filter(contains_ignoring_case(F.col("Service_Description"), part))
    if not is_open(date_from):
        rows = rows.filter(F.col("Service_Date") >= F.lit(str(date_from)).cast("date"))
    if not is_open(date_to):
        rows = rows.filter(F.col("Service_Date") <= F.lit(str(date_to)).cast("date"))
    return rows.join(tables["Client"].select("Client_ID", "Client_Name"), "Client_ID").select(
        "Service_ID", "Client_ID", "Client_Name", "Service_Description", "Service_Date", "Property_Location")
