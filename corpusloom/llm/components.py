"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import new_path, write_once


def _written(edges: DataFrame) -> DataFrame:
    return write_once(edges, new_path(edges.sparkSession, "star-edges"))


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every neighbour that is larger (or not larger) than a vertex to the smallest
    vertex among them. A star's centre counts its neighbours with map-side combine and meets
    them in a join, which may be split where a centre has very many."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["v"])
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (its smallest vertex) of every vertex of ``edges(a, b)``.

    Each round halves the work left or better; a round's edges are written to the shared
    folder, so a lost executor costs a re-read. Loops and repeated edges do not matter, nulls
    link nothing, no edges give no rows.
    """
    edges = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        edges = _written(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    centres = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionAll(centres)
