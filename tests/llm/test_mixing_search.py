"""Mixing, lexical search and importance resampling against plain versions on small and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import lexical, mixing, resample

ODD = ["", None, " ", "\n\t", "a", "the The THE", "é ü　 z 漢字 👍🏽 İ", "a\x00b c-d_e", "x" * 3000, "word " * 3000, "same words here", "same words here"]
DOCS = "doc_id long, text string, source string, n_chars long, score double, rank int, no long, shard string, query long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, None, 0.5, 7, 3, "x", 1) for i, t, s in rows], DOCS)


def prose(r, n):
    return " ".join(r.choice(["Alpha", "beta", "gamma", "été", "x1", "漢字", "zz", "the", "The"]) for _ in range(n))


# mixing


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 97])
def test_places_are_permuted_and_found_back(spark, n):
    key = [F.lit(1), F.lit(2)]
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), *key).alias("to")).select("*", mixing.permuted(F.col("to"), F.lit(n), *key, back=True).alias("back")).collect()
    assert sorted(r["to"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)
    if n == 97:
        assert [r["to"] for r in sorted(rows, key=lambda r: r["id"])] != list(range(n))


@pytest.mark.parametrize("total,marked,drawn", [(10, 4, 5), (50, 1, 25), (1000, 990, 500), (7, 7, 3), (7, 0, 3), (9, 4, 0), (9, 4, 9), (400, 40, 200)])
def test_draws_have_the_distribution(spark, total, marked, drawn):
    """At evenly spread shares each value is met as often as its probability says."""
    n = 4000
    c = lambda v: F.lit(v).cast("long")
    got = Counter(r["x"] for r in spark.range(n).select(mixing.hypergeometric(c(total), c(marked), c(drawn), (F.col("id") + 0.5) / n).alias("x")).collect())
    for x in range(marked + 1):
        p = math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn) if 0 <= drawn - x <= total - marked else 0
        assert abs(got[x] - p * n) <= 1.01, (x, got[x], p * n)


def filled(sizes):
    """Targets by filling to the caps, one source after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        share = {s: free * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s, v in share.items() if v > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        capped |= over


def test_mix_meets_targets_and_shards_hold_their_share(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.choice([0, 1, 3, 40, 300])), r.choice(["a", "b", "é", "Z", "big", "big", "big", None])) for i in range(300)]
    rows += [(1000, prose(r, 4000), "a"), (1001, prose(r, 3), "tiny"), (1002, "", "nothing"), (5, "again", "a"), (5, "again", "a"), (None, "one two", None), (None, "one two", None)]
    docs = documents(spark, rows)
    small = {"block": 16, "shard": 64}
    found = mixing.taken(docs, **small).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    targets = filled(sizes)
    source = {(i, t): s for i, t, s in rows}
    assert len(found) == len(rows)
    assert Counter((x["doc_id"], x["size"]) for x in found) == Counter((i, words(t)) for i, t, _ in rows)
    assert all(0 <= x["taken"] <= 2 * x["size"] for x in found)
    by_source = Counter()
    for x in mixing.pieces(docs, ("source",), **small).filter("n_words > 0").collect():
        by_source[x["kept"]["source"]] += x["n_words"]
        assert abs(x["target"] - targets[x["kept"]["source"]]) < 1e-6 and x["source_size"] == sizes[x["kept"]["source"]]
    assert {s: math.floor(v + 0.5) for s, v in targets.items() if v} == dict(by_source)
    # blocks: none twice in a round, shards as large as each other, texts as cut
    own = mixing.quotas(mixing.sources(docs.select("source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size"))), 16)
    draws = mixing.drawn(own, 16, 64).collect()
    assert len({(d["no"], d["round"], d["block"]) for d in draws}) == len(draws) == len({(d["no"], d["place"]) for d in draws})
    held = Counter(d["shard"] for d in draws)
    assert set(held) == set(range(-(-len(draws) // 64))) and max(held.values()) - min(held.values()) <= 1
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(tuple((t or "").split()))
    mixed = mixing.mixture(docs, **small).collect()
    assert sum(m["n_words"] for m in mixed) == sum(by_source.values())
    for m in mixed:
        assert any(tuple(m["text"].split(" ")) == t[m["first"]:m["first"] + m["n_words"]] for t in texts[m["doc_id"]])
    places = defaultdict(list)
    for m in mixed:
        places[m["shard"]].append(m["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = mixing.taken(docs.repartition(7), **small).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mix_of_odd_documents(spark):
    found = {x["doc_id"]: x for x in mixing.taken(documents(spark, [(i, t, "s") for i, t in enumerate(ODD)])).collect()}
    assert [found[i]["size"] for i in range(len(ODD))] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ODD]
    total = sum(x["size"] for x in found.values())
    assert sum(x["taken"] for x in found.values()) == math.floor(1.5 * total + 0.5) and found[0]["target"] == 1.5 * total
    assert mixing.taken(documents(spark, [])).count() == 0
    nothing = mixing.taken(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((x["doc_id"], x["size"], x["target"], x["taken"]) for x in nothing) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_a_large_source_is_parted_by_levels(spark):
    """Enough shards that the tree's nodes are dealt anew on the way."""
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    assert mixing.taken(docs, block=16, shard=32).agg(F.sum("taken")).first()[0] == 36_000
    held = mixing.pieces(docs, block=16, shard=32).filter("n_words > 0").select("shard", "no", "place").distinct().groupBy("shard").count().collect()
    assert len(held) > 64 and max(h["count"] for h in held) - min(h["count"] for h in held) <= 1


# lexical search


def ranked(docs, items, top=20):
    terms = lambda t: [x.translate(str.maketrans(lexical.UPPER, lexical.LOWER)) for x in re.findall(lexical.TERM, t or "")]
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t, _ in docs if terms(t)]
    n, all_terms = len(own), sum(x[2] for x in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in own:
            m = 75 + 25 * size * n // all_terms
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, k in Counter(terms(text)).items() if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return Counter(out)


def test_search_finds_what_a_plain_search_finds(spark):
    r = random.Random(3)
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(i, prose(r, r.choice([1, 3, 3, 50])), None) for i in range(20, 300)] + [(None, "alpha zz", None), (25, "alpha zz", None), (25, "alpha zz", None)]
    items = [(1, "ALPHA beta alpha"), (2, ""), (3, None), (None, "zz 漢字 été Été"), (4, "absent"), (5, "same words here same"), (5, "the"), (6, prose(r, 400))]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, score string")
    for options in ({}, {"shard_chars": 200, "block_terms": 3}, {"top": 3, "shard_chars": 1}):
        found = lexical.search(documents(spark, rows).repartition(5), frame, **options)
        assert Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found.collect()) == ranked(rows, items, options.get("top", 20))
    assert lexical.search(documents(spark, []), frame).count() == 0
    assert lexical.search(documents(spark, rows), frame.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "alpha", None) for i in range(200, 0, -1)]
    found = lexical.search(documents(spark, rows), spark.createDataFrame([(0, "alpha")], "item_id long, text string"), shard_chars=60)
    assert [x["doc_id"] for x in sorted(found.collect(), key=lambda x: x["rank"])] == list(range(1, 21))


# importance resampling


def resampled(docs, target, longest, buckets, least, percent):
    low = str.maketrans(resample.UPPER, resample.LOWER)

    def features(t):
        w = re.findall(resample.WORD, (t or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t, _ in docs]
    s, t = Counter(b for x in own for b in x[2]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = [(*x, k + 1) for k, x in enumerate(able[: len(able) * percent // 100])]
    rest = Counter(out) - Counter(x[:5] for x in drawn)
    return Counter((i, f, w, s, k) for i, _, f, w, s, k in drawn) + Counter({(i, f, w, s, None): n for (i, _, f, w, s), n in rest.items()})


@pytest.mark.parametrize("longest,buckets,least,percent", [(1, 10_000, 20, 10), (2, 50, 1, 40), (3, 7, 0, 100)])
def test_resampling_draws_what_a_plain_version_draws(spark, longest, buckets, least, percent):
    r = random.Random(4)
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(i, prose(r, r.choice([1, 19, 20, 60])), None) for i in range(20, 200)] + [(None, prose(r, 30), None), (25, "alpha " * 30, None), (25, "alpha " * 30, None)]
    target = ["Alpha beta", None, "", "漢字 zz zz " * 20]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    options = {"longest": longest, "buckets": buckets, "min_words": least, "percent": percent}
    found = resample.resample(documents(spark, rows).repartition(3), frame, **options)
    assert Counter(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect())) == resampled(rows, target, longest, buckets, least, percent)
    assert resample.resample(documents(spark, []), frame, **options).count() == 0
    assert resample.resample(documents(spark, rows), frame.limit(0), **options).count() == len(rows)
