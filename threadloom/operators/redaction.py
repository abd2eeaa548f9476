"""What is secret in one text of a tree is masked in all its texts: prompts, commands, inputs and evidence alike.

Each text is scanned where it stands; the distinct matches of a tree are its dictionary, longest first, in blocks of at most
BLOCK entries. A round masks one block in all texts of its trees, so that a row carries one block at most, however many secrets
a tree has, and the order of the whole dictionary holds. A block table is sent to all tasks only up to a checked size; beyond,
it is joined by tree. Null texts stay null, and trees without findings are left as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import secrets
from ..shared import cut, spread

#: Entries of a block, and letters of all matches of a round up to which its table is sent to all tasks.
BLOCK, SENT = 256, 1 << 22


def dictionary(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, block and entries (n, first, match, rule, as secrets.replacements has them) from rows with an array column found.

    order says which row's finding comes first; the last finding of a match names it. Matches are at most once in a tree.
    """
    each = found.select(key, F.struct(*order).alias("_o"), F.posexplode_outer("found").alias("_i", "f")).filter("f is not null and not startswith(f.match, '[REDACTED:')")
    own = each.groupBy(key, F.col("f.match").alias("match")).agg(F.min(F.struct("_o", "_i")).alias("first"), F.max_by("f.rule", F.struct("_o", "_i")).alias("rule"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.length("match").desc(), "first")) - 1
    placed = own.withColumn("_p", place).withColumn("block", F.floor(F.col("_p") / BLOCK).cast("int"))
    entry = F.struct("_p", (-F.length("match")).alias("n"), F.col("_p").alias("first"), "match", "rule")
    return placed.groupBy(key, "block").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def everywhere(rows: DataFrame, key: str, order: list[str], text: str = "text", soft: bool = True) -> DataFrame:
    """rows with every secret of a tree (key) masked in all its texts; order tells the texts of a tree apart, and which comes first.

    With soft unset only what blocks is masked. The texts are scanned once more after the last round, for what masks have left.
    """
    keep = lambda f: F.lit(soft) | (f["severity"] != "soft")
    scanned = secrets.scanned(spread(rows.select(key, *order, text), key, *order), text).select(key, *order, F.filter("found", keep).alias("found"))
    blocks = cut(dictionary(scanned, key, order))
    letters = F.sum(F.aggregate("entries", F.lit(0), lambda a, e: a + F.length(e["match"])))
    sizes = {r["block"]: r["letters"] for r in blocks.groupBy("block").agg(letters.alias("letters")).collect()}
    out = rows
    for block in sorted(sizes):
        own = blocks.filter(F.col("block") == block).select(F.col(key).alias("_key"), "entries")
        own = F.broadcast(own) if sizes[block] <= SENT else own.hint("shuffle_merge")
        masked = F.when(F.col("entries").isNull(), F.col(text)).otherwise(secrets.masked_by(F.col(text), F.col("entries")))
        out = out.join(own, F.col(key) == F.col("_key"), "left").withColumn(text, masked).drop("_key", "entries")
        if block % 8 == 7:
            out = cut(out)
    return secrets.redacted(out, text)
