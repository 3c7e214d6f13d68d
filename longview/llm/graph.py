"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and the neighbours below it are tied to the smallest of them (every edge has a > b)."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    tied = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge (a, b) names.

    Nodes are longs. Loops, repeated edges and either direction are allowed; null ends are left out. The steps are those of the
    two-phase star algorithm, whose number of rounds grows with the logarithm of the node count; every round is written to the
    checkpoint folder, so a lost executor costs one round. Minima are combined before the shuffle and the joins split skewed
    nodes, so a hub may touch any share of the edges.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = cut(edges), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
        edges = cut(_small_star(_large_star(edges)))
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
