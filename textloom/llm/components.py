"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, to a node that has none."""
    ends = F.array(
        F.struct(F.col("a").alias("x"), F.lit(1).alias("up")),
        F.struct(F.col("b").alias("x"), F.lit(0).alias("up")),
    )
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.x")
    seen = nodes.agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return seen.filter("up > 1 OR up = 1 AND least = 0").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge: the least node of its component.

    ``edges`` has long columns ``a`` and ``b``; loops and repeated edges do no harm. Each
    round is written to the shared folder; the driver only learns whether all is settled.
    """
    now = stage(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    while not _all_stars(now):
        before, now = now, stage(_small_star(_large_star(now)), "edges")
        drop(now.sparkSession, before)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)
