"""Mixing sources to target weights: block quotas parted exactly among output shards, then disjoint blocks in a permuted order.

Sizes are words. Each source's documents, in the order of a hash, are one stream, cut into blocks of BLOCK words (the last is
shorter). A source is read in whole rounds, and in a last one until its target is met to the word: the last block that is drawn
is trimmed. How many blocks each output shard gets of each source is drawn by a tree: a node halves its range of shards, and its
sources' quotas are parted between the halves by a multivariate hypergeometric draw, so that quotas stay exact on every level and
each shard holds its share of blocks to the block. A shard's blocks of a source are consecutive places of a pseudo-random
permutation of that source's blocks (one for each round, a swap-or-not network, which is a bijection for any number), so that
shards share no block of a round. Inside a shard blocks are shuffled by a hash.

Everything is DataFrame expressions; draws are functions of hashes, so that reruns agree. Texts are read once, to count words;
what is shuffled are rows of numbers. A large source is dealt by ranges like all others.

Defined results: a null or empty text has size 0 and takes part in nothing; a null source is one source, the last; repeated rows
each count; equal rows are interchangeable; a source of size 0 has target 0; an empty table gives no rows; a text of any length
is cut into as many blocks as it needs; other columns, whatever their names, are kept if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, placed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2
#: Words of a block, and blocks of an output shard.
BLOCK, SHARD = 1024, 1024
SEED, ROUNDS = 11, 32
#: Sources and characters of their names up to which the sources' table is sent to all tasks.
FEW, SHORT = 10_000, 1 << 20


def uniform(*key: Column) -> Column:
    """A number above 0 and under 1 from a hash."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def permuted(place: Column, n: Column, *key: Column, back: bool = False, rounds: int = ROUNDS) -> Column:
    """place's image in a pseudo-random permutation of 0 to n - 1, or what has place as its image; never null, so that no filter for nulls works it out twice.

    In each round a place and its partner, its mirror image about a hashed centre, are swapped or not by a hashed bit.
    """
    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*key, i, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    order = F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(rounds))
    return F.coalesce(F.aggregate(order, place.cast("long"), step), F.lit(0))


def hypergeometric(total: Column, marked: Column, drawn: Column, share: Column) -> Column:
    """How many of the drawn are marked, when drawn of total are taken, at a share of the distribution.

    The values are weighed outwards from the mode, up to 12 standard deviations and 12, beyond which no double tells their sum
    from 1; one pass sums the weights and one finds the value.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    mode = F.least(F.least(marked, drawn), F.greatest(F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.floor((d + 1) * (k + 1) / (n + 2))))
    variance = d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))
    steps = F.sequence(F.lit(1), F.ceil(12 * F.sqrt(F.greatest(variance, F.lit(0.0)))).cast("int") + 12)
    up = lambda x: (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
    down = lambda x: x * (n - k - d + x) / ((k - x + 1) * (d - x + 1))
    m, one = mode.cast("double"), F.lit(1.0)

    def weights(a: Column, i: Column) -> tuple[Column, Column]:
        above, below = m + i - 1, m - i + 1
        return F.when(a["up"] > 0, a["up"] * up(above)).otherwise(0.0), F.when(a["down"] > 0, a["down"] * down(below)).otherwise(0.0)

    def add(a: Column, i: Column) -> Column:
        u, v = weights(a, i)
        return F.struct(u.alias("up"), v.alias("down"), (a["sum"] + u + v).alias("sum"))

    def seek(a: Column, i: Column) -> Column:
        u, v = weights(a, i)
        over = F.when(a["left"] < u, mode + i).when(a["left"] < u + v, mode - i)
        found = F.struct(u.alias("up"), v.alias("down"), (a["left"] - u - v).alias("left"), over.cast("long").alias("value"))
        return F.when(a["value"].isNotNull(), a).otherwise(found)

    whole = F.aggregate(steps, F.struct(one.alias("up"), one.alias("down"), one.alias("sum")), add, lambda a: a["sum"])
    start = share * whole - 1.0
    at = F.struct(one.alias("up"), one.alias("down"), start.alias("left"), F.when(start < 0, mode).cast("long").alias("value"))
    value = F.coalesce(F.aggregate(steps, at, seek, lambda a: a["value"]), mode)
    sure = F.when(marked == 0, F.lit(0)).when(marked == total, drawn).when(drawn == 0, F.lit(0)).when(drawn == total, marked)
    return F.coalesce(sure.cast("long"), value)


def sources(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """no (from 0, by code point, null last), source, source_size, first (words of all sources before) and target of every source of base (source, size)."""
    sums = cut(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = cut(placed(sums, [F.col("source").asc_nulls_last()], first=F.col("source_size")).withColumnRenamed("_row", "no"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("no") % len(weights)).cast("int"))
    ranked = ranked.withColumns({"_w": weight.cast("long"), "_most": most * F.col("source_size")})
    level, full = 0.0, -1
    while True:
        above = F.lit(level) * F.col("_w") > F.col("_most")
        now = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("_most")).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("_w"))).alias("w"), F.count_if(above).alias("full")).first()
        if not now["all"] or not now["w"] or now["full"] == full:
            break
        full, free, w = now["full"], now["all"] * percent / 100 - now["held"], now["w"]
        level = free / w
    share = F.lit(free) * F.col("_w") / F.lit(w) if level else F.lit(0.0)
    return ranked.select("no", "source", "source_size", "first", F.when(F.lit(level) * F.col("_w") > F.col("_most"), F.col("_most").cast("double")).otherwise(share).alias("target"))


def quotas(own: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """sources with words (the target, rounded), blocks (of one round), draws (of all rounds) and trim (words of the last draw)."""
    size, words, blocks = F.col("source_size"), F.col("words"), F.col("blocks")
    own = own.withColumns({"words": F.round("target").cast("long"), "blocks": F.ceil(size / block).cast("long")})
    own = own.withColumns({"rounds": F.when(size > 0, F.floor(words / F.nullif(size, F.lit(0)))).otherwise(0).cast("long")})
    # the last round's words, and the place at which it meets the stream's last, shorter block
    own = own.withColumns({"rest": words - F.col("rounds") * size, "short": permuted(blocks - 1, F.greatest(blocks, F.lit(1)), F.lit(seed), F.col("no"), F.col("rounds"), back=True), "lack": blocks * block - size})
    whole = F.ceil(F.col("rest") / block).cast("long")
    sum_of = lambda n: n * block - F.when(F.col("short") < n, F.col("lack")).otherwise(0)
    own = own.withColumn("last", F.when(F.col("rest") == 0, 0).when(sum_of(whole) >= F.col("rest"), whole).otherwise(whole + 1).cast("long"))
    own = own.withColumn("trim", F.when(F.col("rest") > 0, F.col("rest") - sum_of(F.col("last") - 1)).otherwise(F.lit(block)).cast("long"))
    return own.withColumn("draws", F.coalesce(F.col("rounds") * blocks + F.col("last"), F.lit(0)).cast("long")).drop("rest", "short", "lack", "last", "rounds")


def split(nodes: DataFrame, draws: int, shards: int, seed: int = SEED) -> DataFrame:
    """One level of the tree: nodes (low, high, parts) with more than one shard give way to their halves."""
    edge = lambda i: F.floor(i.cast("decimal(38,0)") * F.lit(draws) / F.lit(shards)).cast("long")
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
    own = nodes.withColumns({"middle": middle, "room": edge(middle) - edge(F.col("low")), "total": edge(F.col("high")) - edge(F.col("low"))})

    def part(a: Column, p: Column) -> Column:
        got = hypergeometric(a["rest"], p["quota"], a["room"], uniform(F.lit(seed), F.col("low"), F.col("high"), p["no"]))
        return F.struct((a["rest"] - p["quota"]).alias("rest"), (a["room"] - got).alias("room"), F.concat(a["left"], F.array(got)).alias("left"))

    start = F.struct(F.col("total").alias("rest"), F.col("room"), F.array().cast("array<long>").alias("left"))
    own = own.withColumn("left", F.aggregate("parts", start, part, lambda a: a["left"]))
    halves = [
        F.struct(F.col(a).alias("low"), F.col(b).alias("high"), F.filter(F.zip_with("parts", "left", parted), lambda p: p["quota"] > 0).alias("parts"))
        for a, b, parted in (
            ("low", "middle", lambda p, n: p.withField("quota", n)),
            ("middle", "high", lambda p, n: p.withField("begin", p["begin"] + n).withField("quota", p["quota"] - n)),
        )
    ]
    whole = F.struct("low", "high", "parts")
    # an inner generator would infer a filter, for which all draws were made once more
    return own.select(F.explode_outer(F.when(F.col("high") - F.col("low") > 1, F.array(*halves)).otherwise(F.array(whole))).alias("_n")).select("_n.*")


def drawn(own: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """no, block, round, shard, place (in the source's draws) and words (of the block) for every draw; own comes from quotas."""
    parts = F.struct("no", F.lit(0).cast("long").alias("begin"), F.col("draws").alias("quota"), "blocks", "draws", "trim", "source_size")
    root = cut(own.filter("draws > 0").agg(F.sort_array(F.collect_list(parts)).alias("parts"), F.sum("draws").alias("all")))
    draws = root.first()["all"] or 0
    shards = max(1, -(-draws // shard))
    nodes = root.filter("all > 0").select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "parts")
    most = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range((shards - 1).bit_length()):
        if level:
            nodes = nodes.repartition(min(1 << level, most))
        if level and level % 5 == 0:
            nodes = cut(nodes)
        nodes = split(nodes, draws, shards, seed)
    leaves = cut(nodes).select(F.col("low").alias("shard"), F.explode("parts").alias("_p"))
    each = leaves.select("shard", "_p.*").select("*", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("quota") - 1)).alias("place"))
    each = each.withColumn("round", F.floor(F.col("place") / F.col("blocks")).cast("long"))
    each = each.withColumn("block", permuted(F.col("place") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("no"), F.col("round")))
    words = F.when(F.col("place") == F.col("draws") - 1, F.least(F.col("trim"), F.lit(block))).otherwise(block)
    return each.select("no", "block", "round", "shard", "place", words.cast("long").alias("words"))


def pieces(docs: DataFrame, columns: tuple[str, ...] = (), block: int = BLOCK, shard: int = SHARD, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """A row for each document's part in a block and each draw of it, and one with null shard for parts that aren't drawn.

    _row tells documents apart; doc_id, size, source_size, target; kept, a struct of the asked columns; shard, no, place, round; first
    (words of the document before the part) and n_words (0 if not drawn).
    """
    kept = F.struct(*columns) if columns else F.lit(None).cast("string")
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), kept.alias("kept"), F.monotonically_increasing_id().alias("_tie"))
    base = cut(base.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")))
    own = cut(quotas(sources(base, weights, percent, most), block, seed))
    streams = placed(base, [F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id"), F.col("size"), F.col("_tie")], _begin=F.col("size")).drop("_h", "_tie")
    table = own.select(F.col("source").alias("_source"), "no", "source_size", "target", "first")
    bound = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("source")), F.lit(0)).alias("chars")).first()
    few = bound["n"] <= FEW and bound["chars"] <= SHORT
    streams = streams.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("_source")))
    begin = F.col("_begin") - F.col("first")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(begin / block), F.floor((begin + F.col("size") - 1) / block)))
    parts = streams.select("_row", "doc_id", "size", "source_size", "target", "kept", "no", begin.alias("_at"), F.explode_outer(spans).alias("block"))
    # Spark takes what comes from one row for small; draws grow with the documents
    found = parts.join(drawn(own, block, shard, seed).hint("shuffle_merge"), ["no", "block"], "left")
    from_ = F.greatest(F.col("_at"), F.col("block") * block)
    to = F.least(F.col("_at") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0)))
    return found.select("_row", "doc_id", "size", "source_size", "target", "kept", "shard", "no", "place", "round", (from_ - F.col("_at")).alias("first"), F.when(F.col("shard").isNull(), 0).otherwise(F.greatest(to - from_, F.lit(0))).alias("n_words"))


def mixture(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """shard, place (from 0 in the shard), doc_id, round and text of every part that the mix takes: the document's words from first on, joined by blanks."""
    own = pieces(docs, ("text",), seed=seed, **options).filter("n_words > 0")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "no", "place"), "no", "place", "_row")
    words = F.regexp_extract_all(F.col("kept.text"), F.lit(WORD), F.lit(0))
    return own.select("shard", (F.row_number().over(local) - 1).alias("place"), "doc_id", "round", "first", "n_words", F.array_join(F.slice(words, F.col("first").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("text"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it) of every document."""
    each = pieces(docs, **options).groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"))
    return each.select("doc_id", "size", "source_size", "target", "taken")
