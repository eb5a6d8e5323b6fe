"""Connected components by alternating large and small stars; shared by the linking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and itself; edges point from u to a smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node reachable.

    Rounds grow with the logarithm of the longest chain.  Every round is written
    to the shared folder, so lineage stays short; no component is ever held by one task.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now = stored(now, "edges")
    for _ in range(most_rounds):
        # Done when all edges lead to roots and every node has one: a forest of stars.
        roots = now.select(F.col("v").alias("u")).distinct()
        sources = now.groupBy("u").count()
        if not sources.where("count > 1").select("u").union(sources.select("u").join(roots, "u", "left_semi")).limit(1).count():
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = stored(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
