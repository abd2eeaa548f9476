"""From transcripts to a tree's nodes, failures and statistics, and their documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import redirects as R
from ..functions import secrets
from ..functions import text as T
from ..operators import failures, sequence, stats
from ..shared import cut
from ..sources import transcripts


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Surviving prompts of native transcripts, as nodes: tree (the file), node_ord, kind, title, text (secrets masked), parent and nudges."""
    prompts = transcripts.with_context(transcripts.records(spark, path)).withColumnRenamed("file", "tree")
    prompts = prompts.withColumn("redirects", R.routed(F.col("text"), F.col("prior_tokens"), F.col("goal_tokens"))["redirects"]).drop("prior_tokens", "goal_tokens")
    prompts = prompts.withColumn("said", T.turn_kind(F.col("text"), F.lit(False), F.col("redirects")))
    kept = sequence.streamed_fold(prompts, ["tree"], ["ord"], T.is_nudge(F.col("text")), T.is_ignored(F.col("text")), told=("said",))
    own = secrets.redacted(sequence.numbered(kept, ["tree"], ["ord"]), "text", soft=True)
    option = F.when(F.col("node_ord") > 1, T.chosen_option(F.col("text")))
    own = own.withColumns({"kind": F.when(F.col("node_ord") == 1, "root").when(option.isNotNull(), "direction").otherwise(F.col("said")), "title": F.when(option.isNotNull(), F.concat(F.lit("Chose option "), option, F.lit(" from the proposed menu"))).otherwise(T.title(F.col("text"))), "parent": F.lag("node_ord").over(sequence.ordered(["tree"], ["node_ord"]))})
    own = secrets.redacted(own, "title")
    return own.withColumn("relationship", F.when(F.col("parent").isNotNull(), T.relationship(F.col("kind")))).select("tree", "node_ord", "ord", "kind", "title", "text", "parent", "relationship", "nudges", "repeats", "reruns", "ts")


def tree_failures(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Failures that rejections are, each at the last node at or before it; known are the nodes, if they are there already."""
    found = transcripts.records(spark, path)
    own = transcripts.rejections(found).withColumnRenamed("file", "tree").select("tree", "ord", "kind", "confidence", F.lit(None).cast("int").alias("node_ord"))
    marks = (nodes(spark, path) if known is None else known).select("tree", "ord", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence"), "node_ord")
    w = sequence.ordered(["tree"], ["ord", "_late"]).rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(marks).withColumn("_late", F.col("node_ord").isNull())
    placed = both.withColumn("node_ord", F.last("node_ord", ignorenulls=True).over(w)).filter("kind is not null and node_ord is not null")
    return failures.deduplicated(failures.from_rejections(placed))


def tree_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row for each tree: prompts, corrections, scope changes, checkpoints, nudges, tool uses, files, tokens and days."""
    found = transcripts.records(spark, path)
    by_node = nodes(spark, path).groupBy("tree").agg(
        F.count("*").alias("prompts"), *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("correction", "corrections"), ("scope-change", "scope_changes"), ("checkpoint", "checkpoints"))),
        F.sum("nudges").alias("nudges"), stats.day_span(F.min(F.try_to_timestamp("ts")), F.max(F.try_to_timestamp("ts"))).alias("days"),
    )
    tools = transcripts.actions(found).groupBy(F.col("file").alias("tree")).agg(F.count("*").alias("tool_uses"), F.count_distinct("path").alias("files"))
    tokens = stats.token_usage(transcripts.usage(found).withColumnRenamed("file", "tree"), ["tree"], "ord")
    return by_node.join(tools, "tree", "left").join(tokens, "tree", "left").na.fill(0, ["tool_uses", "files", "input_tokens", "output_tokens"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document for each tree, its nodes and failures in order; the job fails rather than let a secret through."""
    own = cut(nodes(spark, path))
    clean = secrets.assert_clean(own, "text", "title")
    found = clean.select("tree", F.struct("node_ord", "kind", "title", "text", "parent", "relationship", "nudges").alias("n"))
    bad = tree_failures(spark, path, own).select("tree", F.struct("failure_id", "type", "node_ord", "confidence", "tier").alias("f"))
    both = found.groupBy("tree").agg(F.sort_array(F.collect_list("n")).alias("nodes")).join(bad.groupBy("tree").agg(F.sort_array(F.collect_list("f")).alias("failures")), "tree", "left")
    return secrets.assert_clean(both.select("tree", F.to_json(F.struct("nodes", F.coalesce("failures", F.array()).alias("failures"))).alias("json")), "json")
