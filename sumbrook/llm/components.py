"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")).select("u", F.least("u", "m").alias("m"), "held")
    return join_hot(both, least, "u", "held", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held"))
    moved = join_hot(edges, least, "u", "held", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """From edges (u, v) of longs to (u, root): each node but the roots, with the least node of its component.

    Each round is written to the shared folder. Minima are combined before the shuffle; hubs, the nodes of a large share
    of all edges, get theirs by broadcast, so no task holds a hub's edges. The number of rounds grows with the
    logarithm of the longest path. No edges give no rows.
    """
    seen, now = None, cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select("u", F.col("v").alias("root"))
        large = cut(_large_star(now, mark[0]).distinct())
        seen, now = mark, cut(_small_star(large, large.count()).distinct())
    raise RuntimeError("components did not settle")
