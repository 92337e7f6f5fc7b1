"""Calendar expressions. `as_of` replaces the wall clock so that results can be repeated."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of: str | datetime.date | None = None) -> Column:
    """The reporting date; today when none is given."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def days_after(later: Column, earlier: Column) -> Column:
    """Whole days from `earlier` to `later`; negative when `earlier` lies ahead."""
    return F.datediff(later, earlier)


def period_bounds(year: int, month: int | None = None) -> tuple[datetime.date, datetime.date]:
    """First day of a year or month and the first day after it."""
    start = datetime.date(year, month or 1, 1)
    if month is None or month == 12:
        return start, datetime.date(year + 1, 1, 1)
    return start, datetime.date(year, month + 1, 1)


def in_period(date: Column, month: int | None, year: int | None) -> Column | None:
    """Condition for a month and/or year, None when both are open.

    With a year the condition is a range, which reaches the Parquet scan; `year(d) = y` would not.
    A month or year that does not exist matches nothing.
    """
    if month is not None and not 1 <= month <= 12 or year is not None and not 1 <= year <= 9999:
        return F.lit(False)
    if year is None:
        return None if month is None else F.month(date) == month
    if year == 9999 and month in (None, 12):
        return date >= F.lit(datetime.date(year, month or 1, 1))
    first, after = period_bounds(year, month)
    return (date >= F.lit(first)) & (date < F.lit(after))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def month_name(month: Column) -> Column:
    """Full month name of 1..12, NULL for anything else."""
    return F.when(month.between(1, 12), F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM"))


def default_due_date(due: Column, invoiced: Column) -> Column:
    """Payment is due 15 days after the invoice unless a due date is given."""
    return F.coalesce(due, F.date_add(invoiced, 15))
