"""Connected components by alternating large-star and small-star steps over an edge table.

Every step is a join with a per-node minimum, which is combined before the shuffle.  A node with very many neighbours is one
join key: its edges are streamed against one row, and adaptive execution splits them over tasks; no task holds them
together.  Each step's edges are a written table.  The steps end when the edges
no longer change; then every node points at the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)`` for every node that an edge names; rows: about how many edges there are.

    Self-loops, repeated edges and both directions are allowed; an empty table gives an empty one.
    """
    edges = edges.select("a", "b").where("a <> b")
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before = _checksum(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = scratch.save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", before[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after_table = scratch.save(small.where("a <> b").distinct(), "edges", before[0])
        after = _checksum(after_table)
        scratch.drop(now, large)
        now = after_table
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
