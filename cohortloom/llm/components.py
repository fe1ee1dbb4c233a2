"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import drop_stored, store


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (a, b) of longs; root is the least node reached.

    Alternates large-star and small-star steps, each one aggregation and one join, until
    the edges stop changing; a hub's edges are aggregated before they are shuffled. Rounds
    grow with the logarithm of the longest chain. Loops and repeated edges are harmless, and
    rows with a null end are left out.
    """
    current = store(_down(edges.select("a", "b")), "edges")
    mark = _mark(current)
    while True:
        following = store(_small_star(_large_star(current)), "edges")
        before, mark = mark, _mark(following)
        drop_stored(current)
        current = following
        if mark == before:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return _down(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _down(moved.unionByName(least.select("a", F.col("low").alias("b"))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
