"""The order of a listing, apart from its content."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crewledger.session import use_checkpoints


def sort_key(name: str) -> Column:
    """`name` ascending, `-name` descending."""
    return F.desc(name[1:]) if name.startswith("-") else F.asc(name)


def listing(*keys: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Sort the rows of a listing by the keys, unless it is called with `ordered=False`.

    A sort of everything moves every row and runs the stage before it twice, once to sample the
    range bounds. A job that stores a listing or works on it further can do without. The last key
    is a primary key where there is one, so that rows alike in the others still spread.
    """

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def sorted_listing(*args, ordered: bool = True, **options) -> DataFrame:
            rows = operator(*args, **options)
            return rows.orderBy(*map(sort_key, keys)) if ordered else rows

        sorted_listing.order = keys
        return sorted_listing

    return decorate


# Rows of a task are numbered in the low bits of Spark's own numbers, the task in the bits above.
ROW_BITS = 33
# Tasks whose sizes are added up in one window; the sums of that many make the second level.
TASKS = 1024


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Checkpointed rows with numbers from 1 in the order in which they lie in the checkpoint.

    A row's number is its place within its task behind the rows of the tasks before. The sizes of tasks are added up
    in two levels, so that no window has more than one row per task of a group, or one per group.
    Nothing is moved, and a task that is run again reads the same rows and numbers them alike.
    """
    taken = {c.lower() for c in rows.columns}
    at = next(n for n in ("_at", "_lies_at", "__lies_at") if n not in taken)
    placed = rows.withColumn(at, F.monotonically_increasing_id())
    task = F.shiftrightunsigned(at, ROW_BITS)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_group", F.expr(f"_task div {TASKS}"))
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    groups_before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("_task", "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_within"))
    groups = sizes.groupBy("_group").agg(F.sum("_size").alias("_sum")).select(
        "_group", F.coalesce(F.sum("_sum").over(groups_before), F.lit(0)).alias("_earlier"))
    # One row for every task.
    offsets = within.join(groups, "_group").select("_task", (F.col("_within") + F.col("_earlier")).alias("_before"))
    own = F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), task == F.col("_task")).select(
        *[placed[c] for c in rows.columns], (F.col("_before") + own + 1).alias(name))


def with_positions(rows: DataFrame, *order: Column, name: str = "Position") -> DataFrame:
    """The rows with their position in an order over all of them, from 1.

    No task gets more than its range of the order: the rows are sorted by ranges and numbered where they then lie. The
    sorted rows are kept in the checkpoint folder, as ranges sampled anew would not be the same. Rows
    equal in the whole order get positions of their own, in any order; end it with a primary key. A position counts all
    rows, so filter afterwards to keep a rank among all, before to rank what is shown.
    """
    use_checkpoints(rows.sparkSession)
    return numbered(rows.orderBy(*order).checkpoint(), name)


def positioned(operator: Callable[..., DataFrame], *args, **options) -> DataFrame:
    """The rows of a listing with the position that its order gives each."""
    return with_positions(operator(*args, ordered=False, **options), *map(sort_key, operator.order))
