"""Connected components by alternating stars; nothing but edges is moved, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a vertex on the smallest one."""
    both_ways = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both_ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return edges.join(least, "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a vertex and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
        least.select("a", F.col("m").alias("b"))
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one other at most, and none that hangs holds others."""
    ends = F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("hangs")), F.struct(F.col("b").alias("id"), F.lit(0).alias("hangs")))
    met = edges.select(F.inline(ends)).groupBy("id").agg(F.sum("hangs").alias("up"), F.count("*").alias("n"))
    return met.where((F.col("up") > 0) & (F.col("n") > 1)).count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """Rows (a, b): every vertex of the edges (a, b) but the smallest of a component, hung on that one.

    Edges point to their smaller end throughout. A round ends in a check of its stars, so those that are
    settled, as edges given as stars are at once, cost no further round; rounds grow as the logarithm of
    the longest path. Hubs are summed on the map side, and the joins on them are splittable.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(down.distinct(), "edges")
    while not _settled(now):
        now = written(_small_star(_large_star(now)).where("a <> b").distinct(), "edges")
    return now


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every vertex of the edges (a, b); a component is its smallest id."""
    now = stars(edges)
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
