"""Failures, chains and lessons from a tree's nodes and rejections, as aggregates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sequence import numbered, padded_id

TIER_RANK = {"inferred": 1, "confirmed": 2, "high": 3, "verified": 4}


def tier_rank(tier: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in TIER_RANK.items() for x in pair))[tier]


def from_rejections(rejections: DataFrame) -> DataFrame:
    """tree, node_ord, type, confidence and tier of the failure that each rejection is."""
    return rejections.select("tree", "node_ord", T.failure_type(F.col("kind")).alias("type"), "confidence", T.tier(F.col("confidence")).alias("tier"))


def deduplicated(failures: DataFrame) -> DataFrame:
    """One failure for each tree, type and node: the highest confidence and tier, numbered by first node and type."""
    best = failures.groupBy("tree", "type", "node_ord").agg(F.max("confidence").alias("confidence"), F.max_by("tier", tier_rank(F.col("tier"))).alias("tier"))
    return numbered(best, ["tree"], ["node_ord", "type"], "_n").withColumn("failure_id", padded_id("failure", F.col("_n"))).drop("_n")


def tier_counts(failures: DataFrame) -> DataFrame:
    """tree and one count for each tier."""
    return failures.groupBy("tree").agg(*(F.count_if(F.col("tier") == t).alias(t) for t in TIER_RANK))


def lessons(failures: DataFrame) -> DataFrame:
    """One lesson for each tree and type: the first node, and how many nodes it is about, numbered by the first node."""
    by_type = failures.groupBy("tree", "type").agg(F.min("node_ord").alias("first_node"), F.count_distinct("node_ord").alias("n_nodes"))
    return numbered(by_type, ["tree"], ["first_node", "type"], "_n").withColumn("lesson_id", padded_id("lesson", F.col("_n"))).drop("_n")


def chain_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.65, "medium").otherwise("low")


def shared_words(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """Pairs (tree, a, b, shared) of turns of one tree, b after a within the reach that right's rows state, with so many words in common.

    left has tree, ord and words; right has besides from_ord and to_ord, the range of turns that it may refer to. The join is
    on tree and word, and only pairs in range are made, so a tree's pairs are as its turns times the reach.
    """
    a = left.select("tree", F.col("ord").alias("a"), F.explode("words").alias("w"))
    b = right.select("tree", F.col("ord").alias("b"), "from_ord", "to_ord", F.explode("words").alias("w"))
    met = a.join(b, ["tree", "w"]).filter("a >= from_ord and a <= to_ord")
    return met.groupBy("tree", "a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def ranked_constraints(constraints: DataFrame, top: int = 10) -> DataFrame:
    """The top constraints of each tree: by weight (the highest), number and recency, then by the first place; their label is the latest of the highest weight.

    constraints has tree, node_ord, place (in the node), key, label and weight. A tree's constraints are ranked in one task, after
    those of one key are one row.
    """
    by_key = constraints.groupBy("tree", "key").agg(
        F.max_by("label", F.struct("weight", "node_ord")).alias("label"), F.max("weight").alias("weight"), F.count("*").alias("n"), F.max("node_ord").alias("last_node"), F.min(F.struct("node_ord", "place")).alias("_first"),
    )
    w = Window.partitionBy("tree").orderBy(F.desc("weight"), F.desc("n"), F.desc("last_node"), "_first")
    return by_key.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("_first")
