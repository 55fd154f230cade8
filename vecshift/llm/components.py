"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``) other than the roots; a root is its component's least node.

    Alternating star contractions: each node's larger neighbours, then its smaller ones, are linked to the
    least neighbour, until every component is a star. Rounds grow with the logarithm of the longest path. Each
    round's edges are written, so a lost executor costs at most one round. A node with very many neighbours is
    one row of the minima and a skewed key of a join, which adaptive execution splits.
    """
    proper = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    current = materialize(proper, "edges0")
    stamp = None
    for i in range(1, most_rounds + 1):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"edges{i}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        rest = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        current = materialize(rest.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), f"edges{i}")
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == stamp:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        stamp = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
