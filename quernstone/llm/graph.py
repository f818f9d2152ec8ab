"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Of every node, its larger neighbours become neighbours of the smallest one instead."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
    return both.withColumn("low", low).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of every node, its smaller neighbours and itself become neighbours of the smallest one. Edges go from larger to smaller."""
    low = F.min("b").over(Window.partitionBy("a"))
    wide = edges.withColumn("low", low)
    return wide.select("a", F.col("low").alias("b")).union(wide.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge to another; label is the smallest node of its component, itself included.

    edges: columns a and b. Loops, repeated edges and either direction are fine. Steps until
    nothing changes, a number that grows with the logarithm of the nodes squared at most.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # the sum may wrap: xxhash64 values are added as decimals
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        before = seen
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
