"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import join_split, materialise, release


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` for every id in ``edges`` (a, b long) that isn't the smallest of its component: label is the smallest.

    Edges point from larger to smaller ids. A step first lets each edge point to the smallest neighbour
    of its end, then each node, and all it pointed to, to the smallest of these. Each half is a table of
    the least neighbours, written to the shared folder, and a join with it; the edges of a node with many are dealt
    out. Steps end when the edges are stars: all of a node's have the same end, and no end has one itself.
    Equal edges are dropped after each step. Self-loops and null ends are dropped.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        least = materialise(now.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")))
        ends = join_split(now, least.select(F.col("a").alias("b"), "m"), ["b"], "left")
        large = materialise(ends.select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")))
        lowest = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"), F.max("moved").alias("moved")))
        if not lowest.where("moved").head(1) and not least.where("m < most").head(1):
            release(now, large, lowest)
            return least.select(F.col("a").alias("id"), F.col("m").alias("label"))
        small = join_split(large.select("a", "b"), lowest.select("a", "m"), ["a"], "inner", lowest.select("a", "n"))
        after = materialise(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        release(now, least, large, lowest)
        now = after
