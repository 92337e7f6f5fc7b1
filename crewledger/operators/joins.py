"""The two outer joins the reports need, written so that no task receives a hot group.

Inner joins need no helper: adaptive execution splits an oversized partition on either side.
An outer join can only be split on the side whose rows are all kept, hence the two forms here.
Broadcasting is left to the optimizer, which checks the size of a side before it does so.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, parents: DataFrame, key: str, row_key: str | list[str]) -> DataFrame:
    """Left join of many `rows` to at most one parent each; `key` names the column on both sides.

    Rows without a key never match, but would all hash to one partition. The second join condition
    is implied by the first for rows with a key, and spreads the others by their own `row_key`.
    """
    row_keys = [row_key] if isinstance(row_key, str) else row_key
    own = F.xxhash64(*row_keys)
    left = rows.withColumn("_spread", F.when(F.col(key).isNull(), own).otherwise(F.xxhash64(key)))
    right = parents.withColumnRenamed(key, "_parent_key").withColumn("_parent_spread", F.xxhash64("_parent_key"))
    matches = (F.col(key) == F.col("_parent_key")) & (F.col("_spread") == F.col("_parent_spread"))
    return left.join(right, matches, "left").drop("_spread", "_parent_key", "_parent_spread")


def presence(links: list[tuple[DataFrame, dict[str, int]]]) -> DataFrame:
    """(key, present): for every key the bits of all columns it occurs in, from (table, {column: bit}).

    Each table is read once for all its columns, and all levels of a tree of tables share one aggregation on the
    keys alone. Equal numbers of different tables are told apart by their bits. As `present` is no grouping key, a
    filter on it stays above the aggregation, which is then computed once for all who ask.
    """
    parts = [
        table.select(F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(bit).alias("bit")) for c, bit in columns.items()])).alias("k"))
        for table, columns in links
    ]
    keys = functools.reduce(DataFrame.unionAll, parts).select("k.key", "k.bit").filter("key IS NOT NULL")
    return keys.groupBy("key").agg(F.bit_or("bit").alias("present"))


def childless(present: DataFrame, own: int, children: int, key: str) -> DataFrame:
    """The keys that have the bit `own` and none of the bits `children`."""
    return present.filter(F.col("present").bitwiseAND(own | children) == own).select(F.col("key").alias(key))


def with_childless(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The children plus one row of NULLs for each of `parents`, the keys of those without any.

    An inner join of all parents with the result equals their left join with the children. The
    inner join can be split when one parent owns most children; the left join could not.
    """
    return children.filter(F.col(key).isNotNull()).unionByName(parents, allowMissingColumns=True)
