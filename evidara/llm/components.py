"""Connected components of an edge table, by alternating star contractions over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) bigint -> (node, component): the smallest node reachable, for every node with an edge.

    Large-star links every larger neighbour of a node to the smallest node around it, small-star the smaller ones;
    each keeps the components and both never hold more edges than there were. A node's neighbours are never gathered:
    each step is one minimum per node joined back to the edges. It ends when two rounds leave the same edges."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node whose own value is its minimum keeps no edge to itself
        large = written(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct())
        dropped(large)
        dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
