"""Lessons, evaluations and rejections of trees as tables, and as the texts that are written of them.

emissions has tree, seq (the order in which failures were found; unique in a tree), type, node (an ord), text (of the failing
turn), correction (an ord or null), corrected_text, summary and, optionally, lesson (false where none is to be drawn). A tree
has one lesson a type and one evaluation a kind at most, so a document of them is small but for the nodes' numbers.

Defined results: a tree without lessons has no row; nulls in text are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sequence import numbered, padded_id

#: Failures whose texts are never quoted as requirements.
NEVER_QUOTED = ("user_rejected_action", "tool_execution_failed", "model_refused", "permission_denied")
SHOWN = 8


def node_id(ord_: Column) -> Column:
    return padded_id("node", ord_)


def _merged(rows: DataFrame, kind: str, first: list[str], ids: Column) -> DataFrame:
    """One row for each tree and kind: the first row's columns, and the distinct ids in the order in which they came."""
    w = Window.partitionBy("tree", kind).orderBy("seq")
    held = rows.withColumn("_first", F.first("seq").over(w)).select("tree", kind, "seq", *first, F.posexplode(ids).alias("_p", "_id"), "_first")
    head = held.groupBy("tree", kind, "_id").agg(F.min(F.struct("seq", "_p")).alias("_at"), *(F.min_by(c, F.struct("seq", "_p")).alias(c) for c in first))
    return head.groupBy("tree", kind).agg(F.min("_at.seq").alias("seq"), *(F.min_by(c, "_at").alias(c) for c in first), F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("ids"))


def lessons(emissions: DataFrame) -> DataFrame:
    """tree, lesson_id, type, title, text and ids (of nodes) of each tree's lessons, in the words of their first failure."""
    drawn = emissions.filter("lesson") if "lesson" in emissions.columns else emissions
    quoted = ~F.col("type").isin(*NEVER_QUOTED)
    worded = drawn.withColumns({"title": T.lesson_title(F.col("type")), "text": T.lesson_text(F.col("type"), F.when(quoted, F.col("text")), F.when(quoted, F.col("corrected_text")))})
    merged = _merged(worded, "type", ["title", "text"], F.array(node_id(F.col("node"))))
    return numbered(merged, ["tree"], ["seq"], "_n").select("tree", padded_id("lesson", F.col("_n")).alias("lesson_id"), "type", "title", "text", "ids")


def evaluations(emissions: DataFrame) -> DataFrame:
    """tree, eval_id, type, task, context, input, expected (an array), failure_mode and ids (of failing and correcting nodes) of each tree's evaluations."""
    quote = lambda lead, text: F.concat(F.lit(lead + ' "'), T.quote(text), F.lit('"'))
    asked = F.when(F.col("type").isin(*NEVER_QUOTED), T.eval_task(F.col("type"))).when(F.col("correction").isNotNull(), quote("Honor this correction and keep building:", F.col("corrected_text"))).otherwise(quote("Honor this stated requirement and keep building:", F.col("text")))
    worded = emissions.select("tree", "seq", T.eval_type(F.col("type")).alias("kind"), T.eval_task(F.col("type")).alias("task"), F.col("summary").alias("context"), asked.alias("input"), T.expected_behavior(F.col("type")).alias("expected"), T.failure_mode(F.col("type")).alias("failure_mode"), "node", "correction")
    ids = F.array_compact(F.array(node_id(F.col("node")), F.when(F.col("correction").isNotNull(), node_id(F.col("correction")))))
    merged = _merged(worded, "kind", ["task", "context", "input", "expected", "failure_mode"], ids)
    return numbered(merged, ["tree"], ["seq"], "_n").select("tree", padded_id("eval", F.col("_n")).alias("eval_id"), F.col("kind").alias("type"), "task", "context", "input", "expected", "failure_mode", "ids")


def evaluation_lines(found: DataFrame) -> DataFrame:
    """tree, eval_id and json: one line for each evaluation."""
    fields = F.struct(F.col("eval_id").alias("id"), "type", "task", "context", "input", F.col("expected").alias("expected_behavior"), "failure_mode", F.col("ids").alias("sourceNodeIds"))
    return found.select("tree", "eval_id", F.to_json(fields).alias("json"))


def lessons_markdown(found: DataFrame) -> DataFrame:
    """tree and markdown: a heading and one line for each lesson, with the first eight of its nodes."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    own = F.when(F.contains(plain, F.lit("Specifically:")), F.trim(F.regexp_extract(plain, r"Specifically:(.*)$", 1))).otherwise(plain)
    more = F.when(F.size("ids") > SHOWN, F.concat(F.lit(", +"), (F.size("ids") - SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    line = F.concat(F.lit("- **"), T.escape_markdown(F.col("title")), F.lit(".** "), T.escape_markdown(own), F.lit(" ["), F.array_join(F.slice("ids", 1, SHOWN), ", "), more, F.lit("]"))
    each = found.select("tree", F.struct(F.length("lesson_id").alias("n"), "lesson_id", line.alias("line")).alias("l"))
    whole = each.groupBy("tree").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return whole.select("tree", F.concat(F.lit("# Lessons\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def rejection_ledger(rejections: DataFrame) -> DataFrame:
    """Rejections with ts, their own or else their node's, and place, their number in the tree by time and then node; those without a readable time come last.

    rejections has tree, node, kind, ts and node_ts.
    """
    own = rejections.withColumn("ts", F.coalesce("ts", "node_ts")).drop("node_ts")
    return numbered(own, ["tree"], [F.try_to_timestamp("ts").asc_nulls_last(), "node", "kind"], "place")
