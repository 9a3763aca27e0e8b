"""Connected components of an edge table by alternating large-star and small-star steps.

Edges and labels stay distributed; each round is written to the shared folder. A hub's edges are
never gathered: a step is an aggregation (combined map-side) and a join with the minima, in which
they pass one by one. The rounds end when the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges downwards, or edges both ways: then each node's label is known."""
    nodes = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return nodes.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) for each node of edges (a, b); the component is its smallest node."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        now = written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
