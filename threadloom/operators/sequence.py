"""Rules over the order of a tree's turns, as windows. A tree is the key, so trees are each other's parallel work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.spans import BLANKS


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def earlier(keys: list[str], order: list[str]):
    """All rows of the key before the current one."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "node_ord") -> DataFrame:
    """Numbers from 1 in order."""
    return rows.withColumn(name, F.row_number().over(ordered(keys, order)))


def padded_id(prefix: str, number: Column) -> Column:
    """prefix_001 and so on; more digits where needed."""
    text = number.cast("string")
    return F.concat(F.lit(prefix + "_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def seen_before(flag: Column, keys: list[str], order: list[str]) -> Column:
    """Whether the flag held in an earlier row of the key."""
    return F.coalesce(F.max(flag.cast("int")).over(earlier(keys, order)), F.lit(0)) == 1


def latest_before(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that isn't null in an earlier row: an as-of lookup without a join."""
    return F.last(value, ignorenulls=True).over(earlier(keys, order))


def islands(rows: DataFrame, starts: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Runs of rows: each row that starts one opens the next number; rows before the first start have 0."""
    upto = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(upto))


def folded(turns: DataFrame, keys: list[str], order: list[str], nudge: Column, text: str = "text") -> DataFrame:
    """Surviving turns with what was folded into each: exact repeats of the turn before, and nudges.

    A turn that repeats its predecessor's text (white space aside) is dropped and counted in repeats; a nudge that has a
    surviving turn before it in its session is dropped and counted in nudges.
    """
    w = ordered(keys, order)
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    marked = turns.withColumns({"_plain": plain, "_nudge": nudge})
    # a nudge doesn't part a text from its repeat
    marked = marked.withColumn("_last", F.last(F.when(~F.col("_nudge"), F.col("_plain")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_repeat", F.coalesce(~F.col("_nudge") & (F.col("_plain") == F.col("_last")), F.lit(False)))
    # a leading nudge has nothing to fold into and stays
    starts = ~F.col("_repeat") & (~F.col("_nudge") | F.col("_last").isNull())
    cut = islands(marked.withColumn("_start", starts), F.col("_start"), keys, order, "_node")
    sums = cut.groupBy(*keys, "_node").agg(
        F.sum((F.col("_nudge") & ~F.col("_start")).cast("int")).cast("long").alias("nudges"), F.sum(F.col("_repeat").cast("int")).cast("long").alias("repeats")
    )
    kept = cut.filter("_start").drop("_plain", "_nudge", "_last", "_repeat", "_start")
    return kept.join(sums, [*keys, "_node"]).drop("_node")


#: Letters under which no text is a repeat of a longer one, and letters at its end that may differ.
REPEAT_LETTERS, REPEAT_END = 24, 4
#: Letters that both texts of a re-run have, that are equal at their starts (more for commands), and the share of the shorter that is.
RERUN_LETTERS, RERUN_START, RERUN_COMMAND, RERUN_SHARE = 40, 24, 32, 0.5


def repeats(a: str, b: str) -> bool:
    """Whether two texts, blanks collapsed, are equal, or the longer begins with the shorter but for its last letters."""
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= REPEAT_LETTERS and long.startswith(short[: len(short) - REPEAT_END]))


def reruns(a: str, b: str) -> bool:
    """Whether the second text is the first asked again: they begin alike for half of the shorter."""
    if min(len(a), len(b)) < RERUN_LETTERS or a[:RERUN_START] != b[:RERUN_START]:
        return False
    if a.startswith("/") and a[:RERUN_COMMAND] == b[:RERUN_COMMAND]:
        return True
    alike = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return alike / min(len(a), len(b)) >= RERUN_SHARE


def streamed_fold(turns: DataFrame, keys: list[str], order: list[str], nudge: Column, ignored: Column, text: str = "text", bare: Column | None = None, told: tuple[str, ...] = ()) -> DataFrame:
    """Surviving turns, each with its text as later turns have changed it, and nudges, repeats and reruns folded into it.

    Against the text of the node before, as it is by then: a repeat is dropped, and if it is longer, its text is the node's,
    and so are its values of the columns told (what is told by the text, such as the kind); a re-run gives the node its text; a nudge counts. Turns that are to be
    ignored, and none of these, are dropped. bare turns (rejections without a text) always stand. The first turn of a key
    stands unless ignored. A null text is empty; keys may be null.

    A key's turns come sorted, in blocks as Spark sends them, and a node is kept until the next one begins: memory is bounded by
    a block and a node's text, however long a session is.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " "))
    flags = {"_plain": plain, "_nudge": F.coalesce(nudge, F.lit(False)), "_ignored": F.coalesce(ignored, F.lit(False)), "_bare": F.lit(False) if bare is None else F.coalesce(bare, F.lit(False))}
    own = turns.withColumn(text, F.coalesce(text, F.lit(""))).withColumns(flags).repartition(*keys).sortWithinPartitions(*keys, *order)
    counts = ["nudges", "repeats", "reruns"]
    kept = [f for f in own.schema.fields if f.name not in flags]
    schema = S.StructType([*kept, *(S.StructField(c, S.LongType()) for c in counts)])
    names = [f.name for f in kept]

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, at, before = None, None, ""
        for block in blocks:
            done = []
            # in turn: what a row is depends on what the row before has made of the node
            for row in block.to_dict("records"):
                key = tuple(str(row[k]) for k in keys)
                if key != at:
                    done += [node] if node else []
                    node, at, before = None, key, ""
                now, plain = row[text], row["_plain"]
                if node and not row["_bare"] and repeats(before, plain):
                    node["repeats"] += 1
                    if len(now) > len(node[text]):
                        node |= {c: row[c] for c in (text, *told)}
                        before = plain
                elif node and not row["_bare"] and reruns(before, plain):
                    node["reruns"] += 1
                    node[text], before = now, plain
                elif node and not row["_bare"] and row["_nudge"]:
                    node["nudges"] += 1
                elif row["_bare"] or not row["_ignored"]:
                    done += [node] if node else []
                    node, before = {n: row[n] for n in names} | dict.fromkeys(counts, 0), plain
            yield pd.DataFrame(done, columns=schema.names)
        yield pd.DataFrame([node] if node else [], columns=schema.names)

    return own.mapInPandas(run, schema)


def within_next(rows: DataFrame, keys: list[str], order: list[str], wanted: Column, value: Column, reach: int) -> DataFrame:
    """next_value: the value of the first wanted row among the reach rows after each, else null."""
    w = ordered(keys, order).rowsBetween(1, reach)
    return rows.withColumn("next_value", F.first(F.when(wanted, value), ignorenulls=True).over(w))


def within_last(rows: DataFrame, keys: list[str], order: list[str], wanted: Column, value: Column, reach: int) -> DataFrame:
    """last_value: the value of the last wanted row among the reach rows before each, else null."""
    w = ordered(keys, order).rowsBetween(-reach, -1)
    return rows.withColumn("last_value", F.last(F.when(wanted, value), ignorenulls=True).over(w))
