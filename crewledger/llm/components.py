"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewledger.llm.frames import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v): label is the smallest node reachable.

    Every round hooks each label to its smallest neighbour, doubles the pointers until they end in a
    root and contracts the edges to the roots, so a path of any order shrinks geometrically. A node
    with many edges reaches the reducers as one partial minimum per task. Labels and edges are settled
    each round; only whether something is left comes to the driver. Null ends and loops are ignored;
    no edges give no rows.
    """
    edges = settled(edges.filter("u is not null and v is not null and u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        roots = _roots(edges.groupBy(F.col("v").alias("child")).agg(F.min("u").alias("parent")))
        labels = settled(
            labels.join(roots, labels.label == roots.child, "left")
            .select("node", F.coalesce("parent", "label").alias("label"))
        )
        edges = settled(
            edges.join(roots.select(F.col("child").alias("u"), F.col("parent").alias("pu")), "u", "left")
            .join(roots.select(F.col("child").alias("v"), F.col("parent").alias("pv")), "v", "left")
            .select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
    return labels


def _roots(parents: DataFrame) -> DataFrame:
    """(child, parent) with every parent followed to its root; parents are smaller than children."""
    while True:
        parents = settled(parents)
        above = parents.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        longer = parents.join(above, "parent", "left")
        if longer.filter("above is not null").isEmpty():
            return parents
        parents = longer.select("child", F.coalesce("above", "parent").alias("parent"))
