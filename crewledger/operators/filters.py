"""Optional filters: None, '' or an absent value means no filter."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_open(value: Any) -> bool:
    return value is None or (isinstance(value, str) and value == "")


def whole_number(value: Any) -> int | None:
    """A number given as int or text; None for an open filter, and -1, which matches nothing, for other text."""
    try:
        return None if is_open(value) else int(value)
    except ValueError:
        return -1


def equals(df: DataFrame, column: str, value: Any) -> Column:
    """`column = value` with the value brought to the column's type on the driver.

    Text that is not a number matches no number.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType) and isinstance(value, str):
        try:
            value = int(value)
        except ValueError:
            return F.lit(False)
    if isinstance(kind, T.DateType):
        return F.col(column) == F.lit(str(value)).cast("date")
    return F.col(column) == F.lit(value)


def apply_filters(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Keep the rows that equal every value given; open values are skipped."""
    for column, value in spec.items():
        if not is_open(value):
            df = df.filter(equals(df, column, value))
    return df


def match_ids(df: DataFrame, column: str, wanted: Any) -> DataFrame:
    """Keep rows whose id is wanted: one id, a DataFrame of ids (first column), or open for all."""
    if isinstance(wanted, DataFrame):
        # Distinct ids: an id asked for very often reaches the join once.
        ids = wanted.select(F.col(wanted.columns[0]).alias(column)).distinct()
        return df.join(ids, column, "left_semi")
    return apply_filters(df, {column: wanted})
