"""URL filters: listed rules first, and character language models for the rest.

Two smoothed variable-order Markov models of characters, one of accepted and one of rejected URLs, are counted by Spark over
every URL that a rule decides. A character's probability under each order leans on the next shorter context where the longer
one is rare. The counts are exact and grow with the URLs: a table of every n-gram of ORDER characters and the next one, from
which those of shorter contexts are summed. The log-ratio of the two models is computed once for each distinct n-gram, order
by order, and joined to the n-grams of the distinct URLs; n-grams that make up a large share of all, of which there can be
only few (at most SHARES), are joined by broadcast, so that no common one lands in one task. The score of a URL is its mean
log-ratio by character; its threshold is the one that errs least, weighing both kinds alike, on the ruled URLs of a fifth of
hashes, which the models don't see. All is DataFrame expressions.

Defined results: a URL that is null or has no "://" has an empty host and path and is scored as an empty text; where no URL
is ruled, the models are uniform, scores are 0 and the verdict is allow; repeated rows each have a verdict, and each counts;
a URL of any length is read whole; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest fitting rule decides.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER = 5
#: Weight of the shorter context in the smoothing, in counts.
LEAN = 4.0
#: A character's probability without any count, what stands before a text and after it, and the n-grams' greatest number that can be joined by broadcast.
UNIFORM, BEFORE, AFTER, SHARES = 1 / 256, "\x02", "\n", 1000
#: Scores are binned so finely for the threshold.
BIN = 0.01


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case by A-Z alone, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path and, where a rule fits, rule and ruled (its verdict)."""
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"))
    host, path = parts(F.col("_url"))
    own = own.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = F.concat(F.lit("."), "host").endswith("." + h) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return own.withColumns({"rule": rule, "ruled": ruled})


def grams(text: Column) -> Column:
    """Each character of a text and its end, after the ORDER characters before it."""
    padded = F.concat(F.lit(BEFORE * ORDER), text, F.lit(AFTER))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def ratios(counted: DataFrame) -> DataFrame:
    """gram and ratio, the log of its last character's probability after the rest, accepted less rejected; counted has gram, allow and block.

    From the single characters on, an n-gram's probability under each model leans on that of the n-gram without its first
    character. A context is followed by no more kinds of characters than there are, so its sum is a window of a few rows.
    """
    known = None
    for size in range(1, ORDER + 2):
        own = counted.groupBy(F.substring("gram", -size, size).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        if size == 1:
            # one row for all, and so many characters as there are
            own = own.crossJoin(F.broadcast(own.agg(F.sum("allow").alias("allow_all"), F.sum("block").alias("block_all"))))
            own = own.withColumns({f"p_{k}": F.lit(UNIFORM) for k in ("allow", "block")})
        else:
            w = Window.partitionBy(F.substring("gram", 1, size - 1))
            own = own.withColumns({f"{k}_all": F.sum(k).over(w) for k in ("allow", "block")}).join(known, F.substring("gram", -(size - 1), size - 1) == known["_gram"])
        p = {k: (F.col(k) + LEAN * F.col(f"p_{k}")) / (F.col(f"{k}_all") + LEAN) for k in ("allow", "block")}
        known = own.select(F.col("gram").alias("_gram"), *(v.alias(f"p_{k}") for k, v in p.items()))
    return known.select(F.col("_gram").alias("gram"), (F.log("p_allow") - F.log("p_block")).cast("decimal(20,12)").alias("ratio"))


def scored(texts: DataFrame) -> DataFrame:
    """text and score of each distinct text; texts has text, ruled and held, and counts towards a model where it is ruled and not held."""
    of = lambda verdict: F.count_if((F.col("ruled") == verdict) & ~F.col("held"))
    own = cut(texts.groupBy("text").agg(of("allow").alias("allow"), of("block").alias("block")).withColumn("id", F.monotonically_increasing_id()))
    each = own.select("id", "allow", "block", F.explode(grams(F.col("text"))).alias("gram"))
    counted = cut(each.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("n")))
    table = cut(ratios(counted))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # as n sums to the total, at most SHARES n-grams have more than that share of it
    common = table.join(counted.filter(F.col("n") * SHARES > total).select("gram"), "gram", "left_semi").select("gram", F.col("ratio").alias("_common"))
    marked = each.select("id", "gram").join(F.broadcast(common), "gram", "left")
    often = marked.filter("_common is not null").groupBy("id").agg(F.sum("_common").alias("s"), F.count("*").alias("n"))
    rest = marked.filter("_common is null").select("id", "gram").join(table, "gram").groupBy("id").agg(F.sum("ratio").alias("s"), F.count("*").alias("n"))
    sums = often.unionByName(rest).groupBy("id").agg((F.sum("s").cast("double") / F.sum("n")).alias("score"))
    return own.select("id", "text").join(sums, "id").select("text", "score")


def threshold(bins: list[tuple[int, str, int]]) -> float:
    """The bound on the score that errs least on binned scores (bin, verdict, number), both verdicts weighing alike.

    It lies in the middle between two bins, of the widest such gap if several err as little; 0 if a verdict is missing.
    """
    allowed, blocked = ({b: n for b, v, n in bins if v == verdict} for verdict in ("allow", "block"))
    if not allowed or not blocked:
        return 0.0
    places = sorted({*allowed, *blocked})
    a = np.array([allowed.get(b, 0) for b in places]) / sum(allowed.values())
    r = np.array([blocked.get(b, 0) for b in places]) / sum(blocked.values())
    # with the bound below place k, allowed ones before k and blocked ones from k on are wrong
    wrong = np.concatenate([[0], np.cumsum(a)]) + np.concatenate([np.cumsum(r[::-1])[::-1], [0]])
    gaps = np.diff([places[0] - 1, *places, places[-1] + 1])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = int(best[np.argmax(gaps[best])])
    return float(([places[0] - 1, *places][k] + 1 + [*places, places[-1] + 1][k]) / 2 * BIN)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    held = F.pmod(F.crc32("text"), F.lit(5)) == 0
    all_rows = cut(with_rules(pages, rules).withColumn("text", F.concat("host", "path")).withColumn("held", held))
    found = cut(scored(all_rows.select("text", "ruled", "held")))
    # texts are one row each in found, and a common one is many rows' match, which Spark parts by their number
    judged = all_rows.join(found, "text")
    bins = judged.filter("held and ruled is not null").groupBy(F.floor(F.col("score") / BIN).alias("b"), "ruled").agg(F.count("*").alias("n")).collect()
    least = threshold([tuple(r) for r in bins])
    verdict = F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
