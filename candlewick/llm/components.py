"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the least vertex around it."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("m").alias("u"), "v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each vertex joins itself and its smaller neighbours to the least of them. ``u < v`` in ``e``."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(least, "v").where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each vertex hangs on one root, and no root on another vertex."""
    if not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        return False
    return e.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` of each vertex but the roots, the least of their components.

    ``edges``: columns ``u, v`` of one orderable type, no nulls. Each round is
    written to the shared folder, so lineage stays short; rounds end once every
    vertex hangs on its root.
    """
    e = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), "edges")
    while not _are_stars(e):
        e = written(_small_star(_large_star(e)), "stars")
    return e.select("v", F.col("u").alias("root"))
