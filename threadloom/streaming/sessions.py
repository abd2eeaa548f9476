"""Sessions as they are written: new transcript lines become running statistics, by event time with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "tree long, ts timestamp, event_id long, role string, text string"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of turns from the JSON files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def windowed(stream: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts of turns, corrections and declines by session and window; a window is final once the watermark has passed it."""
    kind = T.turn_kind(F.col("text"), F.lit(False))
    return (
        stream.withWatermark("ts", late)
        .groupBy("tree", F.window("ts", length).alias("w"))
        .agg(F.count("*").alias("turns"), F.count_if((F.col("role") == "user") & (kind == "correction")).alias("corrections"), F.count_if((F.col("role") == "user") & T.is_decline(F.col("text"))).alias("declines"))
        .select("tree", F.col("w.start").alias("window_start"), "turns", "corrections", "declines")
    )


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """One row for each run of turns without a gap: its times and number of turns."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("tree", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("turns"))
        .select("tree", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "turns")
    )
