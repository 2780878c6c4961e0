"""Connected components of a graph given by its edges, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmatch.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (``large``) or the smaller and equal neighbours of each node to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    used = both if large else both.filter("v < u")
    low = used.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("m"))
    side = both.filter("v > u") if large else used
    linked = side.join(low, side["u"] == low["k"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node that it can reach.

    Each round is written to the shared folder, so a lost executor costs one round at most; the rounds end when the
    edges are stars around the smallest nodes.  Rows meet by joins on a node, which adaptive execution may split.
    """
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), "components")
    size = None
    while True:
        after = materialise(_star(_star(now, large=True), large=False), "components")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == size or not mark[0]:
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        now, size = after, mark
