"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour of u.

    The key is wrapped, so that the join doesn't take over the grouping's partitions: both
    sides are dealt for the join, which lets Spark split the edges of a centre of many.
    """
    keyed = least.select(F.struct("u").alias("key"), "m")
    return edges.withColumn("key", F.struct("u")).join(keyed, "key")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); a component is named by its least node.

    Each round hangs the larger neighbours of every node on its least neighbour, then the
    smaller ones; the number of rounds grows with the logarithm of the longest path.  Rounds
    are written to the shared folder, and only two numbers a round reach the driver.
    """
    state, rows = None, edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        rows = durable(rows)
        if before is not None:
            discard(before)
        before = rows
        seen = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen:
            return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).union(rows.select("v", "v")).distinct()
        state = seen
        both = rows.union(rows.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _beside(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = _beside(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = hung.union(least.select("u", "m")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
