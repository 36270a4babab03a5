"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import store

#: The steps end by themselves after a number of rounds that grows with the logarithm of the largest component.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs every node's larger (large) or smaller neighbours on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.select(F.col("a"), F.col("least").alias("b")))
    return out.filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the edges (a, b): component is the smallest node that can be reached.

    Nodes without edges don't appear; loops and repeated edges are harmless. Every round is stored in the shared folder.
    """
    edges = store.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        last, edges = edges, store.materialize(_star(_star(edges, True), False), "star")
        store.discard(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
