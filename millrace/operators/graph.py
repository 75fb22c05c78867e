"""Connected components by alternating star operations (Kiveris et al. 2014).

Only minima and equi-joins: a hub with very many neighbours is combined map-side, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    around = _both_ways(edges)
    lowest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return around.filter(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(lowest.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node."""
    current = materialize(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = None
    for _ in range(max_rounds):
        current = materialize(_tidy(_small_star(_tidy(_large_star(current)))))
        # One row of checksums tells whether the edge set still changes.
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
