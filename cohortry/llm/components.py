"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars: rounds grow with the logarithm of the size, each
    round's edges are no more than the last's, and hubs are only ever aggregated to a minimum or joined (which adaptive
    execution splits). Lineage is cut each round. Self-loops are allowed; a node with only those is its own component.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    loops = edges.where("a = b").select("a").distinct()
    edges = cut(edges.where("a > b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.withColumnRenamed("a", "node").join(stars.union(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.union(roots).union(alone)
