"""Connected components by alternating large-star and small-star rounds over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of all nodes of edges (a, b); edges may repeat, have either order and loops.

    Each round ends in a written table. Edges are never gathered: a round is two aggregations and joins on a node,
    whose hot nodes Spark splits. It ends when a round changes nothing.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, both["u"] == low["x"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node's own least neighbour is kept as well, so that no node loses its last edge.
        large = stored(large.unionByName(low.where(F.col("m") < F.col("x")).select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, large["u"] == least["x"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        after = stored(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        forget(large)
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(after, ["u", "v"], "left_anti").limit(1).count()
        forget(now)
        now = after
        if not changed:
            break
    else:
        raise RuntimeError("components have not converged")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
