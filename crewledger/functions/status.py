"""Status and bucket labels. NULL input falls to the last label, as in a searched CASE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in days and labels of the two aging schemes.
AGING_SCHEMES = {
    "short": ([(0, "Current"), (30, "1-30 Days"), (60, "31-60 Days")], "60+ Days"),
    "long": (
        [(0, "Current"), (30, "1-30 Days"), (60, "31-60 Days"), (90, "61-90 Days")],
        "Over 90 Days",
    ),
}


def _first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    chain = F
    for condition, label in cases:
        chain = chain.when(condition, label)
    return chain.otherwise(otherwise)


def aging_bucket(days: Column, scheme: str = "short") -> Column:
    bounds, rest = AGING_SCHEMES[scheme]
    return _first_match([(days <= bound, label) for bound, label in bounds], rest)


def budget_status(variance: Column) -> Column:
    return _first_match([(variance > 0, "Over Budget"), (variance < 0, "Under Budget")], "On Budget")


def schedule_status(date: Column, as_of: Column) -> Column:
    return _first_match([(date < as_of, "Completed"), (date == as_of, "Today")], "Upcoming")


def new_invoice_status(total: Column, paid: Column) -> Column:
    """Status of an invoice as it is entered: nothing paid comes first."""
    return _first_match([(paid <= 0, "Unpaid"), (paid >= total, "Paid")], "Partial")


def settled_invoice_status(total: Column, paid: Column) -> Column:
    """Status of an invoice after payments: fully paid comes first."""
    return _first_match([(paid >= total, "Paid"), (paid > 0, "Partial")], "Unpaid")
