"""Connected components of a graph given as a frame of edges.

Alternating large-star and small-star steps: every node's neighbours are hung
on the smallest node near it until the edges form stars. A step is two
shuffles with partial aggregation; each round is cut by a checkpoint. Hubs are
only keys of a join against one row per node, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component, itself
    included) for every node on an edge. Edges with a null end and loops join
    nothing; a node that only has a loop is its own root. Repeated edges count
    once. No edges: no rows."""
    given = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).dropna()
    given = cut(given.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
    e, state = given.where("u != v"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == state or not now[0]:
            break
        state = now
    nodes = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    return (nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
            .select("node", F.coalesce("root", "node").alias("root")))
