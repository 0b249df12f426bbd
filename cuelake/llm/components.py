"""Connected components by alternating star contraction.

Edges never leave the cluster: the driver sees a count and a checksum for each round.  A round
replaces edges by stars around the least neighbour; rounds end when nothing changes, after about the
logarithm of the longest path.  All groupings are minima, which combine before the shuffle, so a node
with very many neighbours is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_scratch, scratch

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the edges ``a, b`` (bigint): root is the least node of its component.

    Nodes without an edge to another node aren't returned.  Loops and repeated edges do no harm.
    """
    current = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch(large, "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        pairs = large.join(down, large.a == down.u)
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = scratch(small.distinct(), "edges")
        drop_scratch(large)
        after = _signature(small)
        drop_scratch(current)
        current = small
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are still changing after {MAX_ROUNDS} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
