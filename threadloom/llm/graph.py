"""Connected components of an edge table, by alternating stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _hooked(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u's star. least is written out, so that a star of any size can be split in the join."""
    return pairs.join(cut(least), "u")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (a, b).

    Large and small stars alternate: each node's larger neighbours, then its smaller ones and itself, are hooked to the least
    of its star. Edges never grow in number, and the rounds are as the logarithm of the longest path. Null ends are passed over.
    """
    own = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own, before = cut(own), None
    while True:
        both = own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        small = _hooked(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        own = cut(small)
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    roots = own.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
