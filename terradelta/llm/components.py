"""Connected components of a distributed edge list by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root), root the least node of the component; only nodes with an edge to another.

    Each round hooks every node to its least neighbour, follows two pointers and
    replaces edge ends by what they point to, so edges shrink geometrically.  The
    aggregates combine map-side and the joins are ones that Spark splits on skew, so
    a node that touches a third of all edges does no harm.  Edges stay distributed."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
        for _ in range(2):
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hook = hook.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        hook = cut(hook)
        rounds.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
