"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import drop, written


def _is_stars(edges: DataFrame) -> bool:
    """Does every node hang on one root, and no root on another? Both steps leave such edges unchanged, and no others."""
    double = edges.groupBy("a").count().filter("count > 1")
    return double.isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node it can reach.

    edges: two columns of one comparable type, u and v, without nulls; loops and repeated
    edges do no harm. Returns (node, root), one row per node of an edge that is no loop.

    Each round re-hangs every neighbour on the smallest one (large star: neighbours above a
    node; small star: those below), the known O(log^2 n) scheme. Every join key is a node,
    its minimum is pre-aggregated on the map side, and a node that collects many edges is
    split by the skew join of adaptive execution. The edges of each round are written to the
    shared folder, so that neither lineage nor the driver grows.
    """
    now = written(
        edges.filter(F.col(u) != F.col(v))
        .select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
        .distinct(),
        "edges",
    )
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = large.filter(F.col("a") != F.col("b"))
        below = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small_least = below.groupBy("a").agg(F.min("b").alias("m"))
        joined = below.join(small_least, "a")
        small = (
            joined.filter(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(joined.select("a", F.col("m").alias("b")))
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        new = written(small, "edges")
        drop(now)
        now = new
        if _is_stars(now):
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
