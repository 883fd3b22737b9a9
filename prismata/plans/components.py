"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.hot import join_hot
from prismata.plans.shared import materialize


def _larger_to_minimum(edges: DataFrame, n_edges: int, name: str) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), name)
    return materialize(join_hot(both.where("b > a"), least, "a", 2 * n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)


def _smaller_to_minimum(edges: DataFrame, n_edges: int, name: str) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
    moved = join_hot(down, least, "a", n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (long node ids) -> ``(node, component)``, component = smallest node id of the component.

    Nodes without an edge to another node do not come back. Rounds alternate the two contractions, each an
    aggregation with map-side combining, a join that broadcasts the few hubs and shuffles the rest, and a distinct,
    until the edge set stands still; the round count is logarithmic in the longest path. The least neighbours and the edges
    of each contraction are written tables: the join reads both several times, and as one plan a round would hold
    every step above it as often again, which the driver plans, compiles and keeps. A lost executor costs one
    contraction at most. Nulls and self-loops are ignored.
    """
    now = materialize(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), name)
    n, seen = now.count(), None
    for _ in range(max_rounds):
        # a contraction gives no more edges than it gets, and the first gives the second at most as many
        now = _smaller_to_minimum(_larger_to_minimum(now, n, name), n, name)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = mark[0]
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
