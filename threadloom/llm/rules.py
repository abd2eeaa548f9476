"""Quality rules: counts from each text, and a hashed n-gram log-likelihood ratio between trusted and raw documents.

Everything is DataFrame expressions. Each text becomes an array of words, and higher-order functions work on it row by row.
Two multinomials over hashed n-grams (lower-case words, and pairs of neighbouring word shapes) are counted: one over all
trusted documents, one over all documents. A document's score is the mean, over its n-grams, of the log
ratio of the two. It is kept if the score isn't below the trusted documents' mean by more than a number of their standard
deviations; sums are of decimals, so the bound doesn't depend on the order of tasks. The buckets of all n-grams are computed once
and written out as two bytes each, for the counts and for the scores.

Defined results: a null or empty text has no words, counts of 0, and fails; without trusted documents all scores are 0 or
depend on smoothing alone, and the rules decide; repeated rows each count; an empty table gives no rows; a text of any length
is one row's work, in time in proportion to it but for the sort of its windows. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of the filter of trusted ids, for each id and at most.
FILTER_BITS, MAX_BITS = 16, 1 << 24
#: Hash buckets, and standard deviations below the trusted mean that are still kept.
BUCKETS = 1 << 14
DEVIATIONS = 3.0
MIN_WORDS = 50
#: What parts words, as a Java character class and as characters.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def shapes(text: Column) -> Column:
    """The text with each run of capitals as A, of other letters as a, and of digits as 0."""
    out = text
    for pattern, to in ((r"\p{Lu}+", "A"), (r"[\p{L}&&[^A]]+", "a"), (r"\p{N}+", "0")):
        out = F.regexp_replace(out, pattern, to)
    return out


def bucket(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(BUCKETS)).cast("int")


def repeated_words(ordered: str) -> Column:
    """Words that lie in a 3-word window that occurs twice or more; ordered has (hash, place) of each window, sorted."""
    again = F.transform(ordered, lambda s, i: F.when((s["h"] == F.get(ordered, i - 1)["h"]) | (s["h"] == F.get(ordered, i + 1)["h"]), s["i"]))
    places = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def counts(docs: DataFrame) -> DataFrame:
    """_id, _ngrams (their buckets, less BUCKETS / 2) and the base counts of every document."""
    base = prepared(docs, F.col("doc_id").alias("_id"))
    windows = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    base = base.withColumns({"_h": windows, "_l": lines})
    # most texts repeat no window, and need no sort to show it
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed))
    return base.select(
        "_id",
        F.transform(ngrams("_w", "_s"), lambda b: (b - BUCKETS // 2).cast("smallint")).alias("_ngrams"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated_words("_o"), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ngrams(words: str, shaped: str) -> Column:
    """Buckets of the words in lower case and of the pairs of neighbouring shapes, from columns of words and of their shapes."""
    # the last shape's pair has a null second part
    pairs = F.transform(shaped, lambda a, i: bucket(F.lit(" "), a, F.get(shaped, i + 1)))
    return F.concat(F.transform(words, lambda w: bucket(F.lower(w))), pairs)


def prepared(docs: DataFrame, *more: Column) -> DataFrame:
    """_t, the text, _w, its words, and _s, their shapes, each computed once."""
    return docs.select(F.coalesce("text", F.lit("")).alias("_t"), *more).withColumns({"_w": words_of(F.col("_t")), "_s": words_of(shapes(F.col("_t")))})


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents that all their labels call good."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").select(F.col("doc_id").alias("_trusted"))


def maybe_trusted(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of base whose _id may be among ids: all that are, and few others while MAX_BITS allow FILTER_BITS for each id.

    The ids' hashes are bits of whole numbers, a row for every 64 bits that has one set; only these are sent to all tasks.
    """
    bits = min(MAX_BITS, max(64, ids.count() * FILTER_BITS))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(_p % 64 as int))")
    words = ids.select(place("_trusted").alias("_p")).groupBy(F.floor(F.col("_p") / 64).alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    own = base.withColumn("_p", place("_id")).withColumn("_at", F.floor(F.col("_p") / 64))
    return own.join(F.broadcast(words), "_at").filter(F.col("_bits").bitwiseAND(bit) != 0).select(*base.columns)


def weights(base: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with an array of the log ratio of each bucket; base has _id and _ngrams.

    Trusted documents are told exactly, by a join that deals by id whatever the sizes; only what may be trusted is dealt.
    """
    ids, own = trusted_ids(labels), base.select("_id", "_ngrams")
    good = maybe_trusted(own, ids).join(ids.hint("merge"), F.col("_id") == F.col("_trusted"))
    count = lambda rows, name: rows.select(F.explode("_ngrams").alias("_n")).groupBy("_n").agg(F.count("*").alias(name))
    seen = count(own, "raw").join(count(good, "good"), "_n", "left").withColumn("_b", F.col("_n").cast("int") + BUCKETS // 2)
    full = base.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_b")).join(seen, "_b", "left")
    full = full.select("_b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    rows = full.agg(F.sort_array(F.collect_list(F.struct("_b", "raw", "good"))).alias("r"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    ratio = lambda x: F.log((x["good"] + 1) / (F.col("good") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("raw") + BUCKETS))
    return rows.select(F.transform("r", ratio).alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept, for every document."""
    base = cut(counts(docs))
    model = cut(weights(base, labels))
    total = F.aggregate("_ngrams", F.lit(0.0), lambda a, b: a + F.get("_m", b.cast("int") + BUCKETS // 2))
    scored = base.withColumn("_m", model.select("weights").scalar())
    scored = scored.withColumn("score", F.coalesce(total / F.nullif(F.size("_ngrams"), F.lit(0)), F.lit(0.0)).cast("decimal(18,9)")).drop("_ngrams", "_m")
    scored = cut(scored)
    ids = trusted_ids(labels)
    s = F.col("score").cast("decimal(20,9)")
    sums = scored.select("_id", "score").join(ids.hint("merge"), F.col("_id") == F.col("_trusted")).agg(F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("q")).first()
    least = None
    if sums["n"]:
        mean = float(sums["s"]) / sums["n"]
        least = mean - deviations * max(0.0, float(sums["q"]) / sums["n"] - mean * mean) ** 0.5
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.col("score").cast("double") >= F.lit(least) if least is not None else F.lit(True)
    return scored.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"), F.col("score").cast("double").alias("score"))
