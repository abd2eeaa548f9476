"""Aggregates over sessions and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_span(first, last):
    """Days that a span touches: whole days rounded up, one at least; null without times. Takes timestamps."""
    seconds = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return F.when(first.isNotNull(), F.greatest(F.lit(1), F.ceil(seconds / F.lit(86_400_000_000)))).cast("long")


def session_stats(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of turns by role, distinct files and models, first and last time and days; turns has role, ts, file and model."""
    out = turns.groupBy(*keys).agg(
        F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.count_distinct("file").alias("files"), F.count_distinct("model").alias("models"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return out.withColumn("days", day_span(F.col("first_ts"), F.col("last_ts")))


def token_usage(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sums of tokens over messages: a message's last record counts, and records without tokens don't.

    messages has message_id, input_tokens and output_tokens.
    """
    used = messages.filter("input_tokens > 0 or output_tokens > 0")
    last = used.groupBy(*keys, "message_id").agg(F.max_by(F.struct("input_tokens", "output_tokens"), order).alias("u"))
    return last.groupBy(*keys).agg(F.sum("u.input_tokens").alias("input_tokens"), F.sum("u.output_tokens").alias("output_tokens"))


def kind_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def totals(counts: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Each key's sums and, in a row whose key is null, the grand total."""
    return counts.rollup(by).agg(*(F.sum(m).alias(m) for m in measures))
