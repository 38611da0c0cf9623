"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.llm.common import cut, discard


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root), written: root is the smallest node that can be reached. Nodes without edges do not appear.

    Alternates large-star and small-star steps until nothing changes; every node ends up pointing at its root. The number of
    rounds grows with the logarithm of the component's size. Every round is written to the shared folder, and the one before
    deleted. Self-loops and repeated edges are harmless; an empty table gives an empty result.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Link each node's neighbours (large: the larger ones, else the smaller ones) to the smallest node around it."""
        low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = pairs.join(low, "a").where(F.col("b") > F.col("a") if large else F.col("b") <= F.col("a"))
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out if large else out.union(low.select("a", F.col("m").alias("b")))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        return tuple(row)

    now = cut(edges.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(now)
    while was[0]:
        up = star(both(now), True).where("a != b").distinct()
        then = cut(star(up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False).where("a != b").distinct())
        discard(now)
        now, at = then, mark(then)
        if at == was:
            break
        was = at
    out = cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()))
    discard(now)
    return out
