"""Connected components of an edge table by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (u, v); root is the smallest node that it reaches.

    Each round is two aggregations with map-side combine and two joins; its table is checkpointed. Null nodes and loops are left out.
    """
    now = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    for _ in range(most_rounds):
        large = _star(now, larger=True)
        after = cut(_star(large, larger=False))
        # equal edge sets: same size and same sums of hashes
        if _digest(now) == _digest(after):
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return after.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(after.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect the larger neighbours of each node (or its smaller ones and itself) to the smallest of its neighbourhood."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v")
    else:
        flipped = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
        low = flipped.groupBy("x").agg(F.min("y").alias("m"))
        out = flipped.join(low, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).unionByName(low.select(F.col("m").alias("u"), F.col("x").alias("v")))
    return out.where("u < v").distinct()
