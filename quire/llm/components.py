"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.recovery import checkpointed
from quire.llm.skew import hot_keys, spread_join


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the smallest id of its component.

    Self loops are ignored and null ends dropped. Each round replaces the edges
    by edges to smaller neighbours; minima are pre-aggregated before the
    shuffle, the edges of a hub are spread over tasks, and no component is ever
    gathered.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpointed(now)
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    state = None
    for _ in range(max_rounds):
        low = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = low.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("b"), F.least("u", "m").alias("m"))
        hubs = hot_keys(now.groupBy("b").agg(F.count("*").alias("n")), "b")
        large = checkpointed(spread_join(now, low, "b", hubs, F.col("a")).select("a", F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hubs = hot_keys(large.groupBy("a").agg(F.count("*").alias("n")), "a")
        small = spread_join(large, least, "a", hubs, F.col("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
