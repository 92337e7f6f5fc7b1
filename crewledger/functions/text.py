"""Text matching and clean-up. User filters ignore case; group keys and joins do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def contains_ignoring_case(text: Column, part: str) -> Column:
    """Substring test in which NULL counts as empty text."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def like_ignoring_case(text: Column, part: str) -> Column:
    """LIKE '%part%'; `%` and `_` inside `part` stay wildcards, a backslash stands for itself. NULL text never matches."""
    escaped = part.lower().replace("\\", "\\\\")
    return F.lower(text).like(f"%{escaped}%")


def label_or(text: Column, label: str) -> Column:
    """The text, or a label where it is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(label))


def stars(rating: Column) -> Column:
    """One star per point; empty text for no rating."""
    return F.repeat(F.lit("⭐"), F.coalesce(rating, F.lit(0)).cast("int"))
