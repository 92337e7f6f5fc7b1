"""Money expressions on exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AVERAGE = "decimal(14,6)"


def balance(total: Column, paid: Column) -> Column:
    return total - paid


def hourly_rate(cost: Column, hours: Column) -> Column:
    """Cost per hour to the cent; 0 unless both are positive."""
    usable = (cost > 0) & (hours > 0)
    return F.when(usable, F.round(cost / F.when(usable, hours), 2)).otherwise(F.lit(0)).cast("decimal(12,2)")


def average(total: Column, count: Column) -> Column:
    """Total over count with four more digits than money; NULL when the count is 0."""
    return (total / F.nullif(count, F.lit(0)).cast("decimal(20,0)")).cast(AVERAGE)


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0).cast("decimal(10,2)"))
