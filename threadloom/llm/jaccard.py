"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact comparison of word shingles decides.

1. Every text becomes words (lower case, between white space) and a MinHash signature of its shingles of five words. Texts of
   equal words are copies; one text stands for them from here on, so copies cost no pairs.
2. In each tree of the forest, signatures lie in the order of the tree's own choice of minima, which is the order of a trie of
   prefixes. The shortest prefix that counts as a match is the longest at which the expected share of pairs at the threshold
   that meet in some tree reaches TARGET. Trees are sorted by range over all tasks, so that a large bucket is many tasks' work;
   each row gets one edge, to the first row of the longest-matched bucket that it shares with the row before, and the length of
   that match. The tasks' first and last rows join buckets across tasks.
3. Matched prefixes adapt to what they meet. The components of all edges are taken at the shortest match. A component of more
   than LARGE texts, which unlike texts can make by chains of chance matches, is parted again by longer and longer matches into
   cores. Texts of one core are compared all with all. What cores could lose, pairs of one large component that meet in some
   tree but lie in different cores, are compared bucket by bucket, each pair in the first tree where it meets. So the work
   follows cores and buckets, not the square of a component, and no pair that meets at the shortest match is left out.
4. Groups are dealt to blocks by a hash, and each pair of blocks compares its texts exactly, as products of 0-1 matrices. It
   gives counts of links and one edge for each text, not the pairs, so the rows stay in proportion to the texts.
5. Classes are the components of exact links.

Defined results: a text of fewer than five words has all its words as one shingle; texts without words are copies of one
another and have no links; a null text is empty; equal rows are one document; rows that repeat an id with other words are
documents of their own, none of which is lost (the least id of two classes can then be the same); a row without an id stands
alone (its class, copy_id and counts are null); an empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .graph import components

SHINGLE = 5
#: Similarity of a link, as a fraction.
ABOVE, OF = 4, 5
MINIMA, TREES, FULL_DEPTH, TARGET, SEED = 128, 48, 12, 0.999, 11
#: Texts of a component that isn't parted, texts in a block and words in it, columns of a matrix at a time, and words whose hashes a worker keeps.
LARGE, BLOCK, BLOCK_WORDS, COLUMNS, MAX_WORDS = 8192, 512, 1 << 19, 4096, 400_000
#: Minima in which a pair of different cores must agree to be compared; at similarity 0.8 fewer come once in some million pairs.
NEARLY = 78

_rng = np.random.default_rng(SEED)
_MASKS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_FACTORS = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHOICES = np.stack([_rng.permutation(MINIMA)[:FULL_DEPTH] for _ in range(TREES)])


def expected_recall(depth: int, similarity: float = ABOVE / OF, pairs: int = 20_000) -> float:
    """The share of pairs of that similarity that agree in the first depth minima of some tree. Trees share minima, so it is drawn, not computed."""
    agree = np.random.default_rng(SEED).random((pairs, MINIMA)) < similarity
    met = np.zeros(pairs, bool)
    for choice in _CHOICES:
        met |= agree[:, choice[:depth]].all(1)
    return float(met.mean())


def matched_depth(target: float = TARGET) -> int:
    """The longest prefix that meets the target, shortened step by step from the full depth."""
    depth = FULL_DEPTH
    while depth > 1 and expected_recall(depth) < target:
        depth -= 1
    return depth


class Shingler:
    """Words and 64-bit shingle hashes of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return text.lower().split() if text else []

    def grams(self, words: list[str]) -> np.ndarray:
        """A hash for each shingle, in order; none for no words."""
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        each = np.array([known[w] for w in words], dtype=np.uint64)
        if not len(each):
            return each
        if len(each) < SHINGLE:
            each = np.concatenate([each, np.full(SHINGLE - len(each), len(each), np.uint64)])
        odd = np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(len(each) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            out = (out ^ each[k : k + len(out)]) * odd
            out ^= out >> np.uint64(31)
        return out


def signatures(grams: list[np.ndarray]) -> np.ndarray:
    """Sixteen bits of each of the minima, a row for each text; texts without shingles have a row of zeros."""
    n = np.array([len(g) for g in grams])
    out = np.zeros((len(grams), MINIMA), np.uint16)
    full = np.flatnonzero(n)
    if len(full):
        x = (np.concatenate([grams[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(n[full]) - n[full]
        for k in range(MINIMA):
            least = np.minimum.reduceat((x ^ _MASKS[k]) * _FACTORS[k], starts)
            # the high bits of a minimum say little, so all are mixed
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def words_key(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def keyed(text: Column) -> Column:
    """The key of the words' sequence alone."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([words_key(t.lower().split() if t else []) for t in texts])

    return run(text)


def signed(text: Column) -> Column:
    """A struct of key (of the words' sequence), n_words and the signature."""

    @F.pandas_udf("key binary, n_words int, sig binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            texts, rows = batch.tolist(), []
            for a, b in slices([len(t or "") for t in texts]):
                words = [shingler.words(t) for t in texts[a:b]]
                sigs = signatures([shingler.grams(w) for w in words])
                rows += [(words_key(w), len(w), s.tobytes()) for w, s in zip(words, sigs)]
            yield pd.DataFrame(rows, columns=["key", "n_words", "sig"])

    return run(text)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), MINIMA)


def matched(x: bytes, y: bytes) -> int:
    """The minima that two labels of a tree have in common before the first that differs; -1 for different trees."""
    if x[0] != y[0]:
        return -1
    return next((i for i in range(FULL_DEPTH) if x[1 + 2 * i : 3 + 2 * i] != y[1 + 2 * i : 3 + 2 * i]), FULL_DEPTH)


def forest_edges(reps: DataFrame, least: int) -> DataFrame:
    """Edges (a, b, depth): those of depth d or more connect the texts of each bucket of prefixes of d minima, for any d from least on; reps has node and sig."""

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.iloc[begin : begin + 2000]
                sigs = _signatures(part["sig"]).byteswap()
                for tree in range(TREES):
                    prefix = np.ascontiguousarray(sigs[:, _CHOICES[tree]])
                    label = [bytes([tree]) + p.tobytes() for p in prefix]
                    yield pd.DataFrame({"label": label, "node": part["node"].to_numpy()})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"a": "Int64", "b": "Int64", "depth": "Int32"}
        # the first row of the current bucket at each depth
        heads, before, first_row = [0] * (FULL_DEPTH + 1), None, None
        for batch in batches:
            a, b, depth = [], [], []
            for label, node in zip(batch["label"], batch["node"]):
                met = -1 if before is None else matched(before, label)
                if met >= least:
                    a.append(heads[met])
                    b.append(node)
                    depth.append(met)
                for d in range(max(met, -1) + 1, FULL_DEPTH + 1):
                    heads[d] = node
                before, last = label, (label, node)
                first_row = first_row or last
            yield pd.DataFrame({"a": a, "b": b, "depth": depth, "label": None}, columns=["a", "b", "depth", "label"]).astype(kinds)
        if before is not None:
            ends = [first_row, last]
            yield pd.DataFrame({"a": [n for _, n in ends], "b": [None, None], "depth": [None, None], "label": [x for x, _ in ends]}).astype(kinds)

    labels = reps.select("node", "sig").mapInPandas(plant, "label binary, node long")
    sorted_labels = labels.repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    found = cut(sorted_labels.mapInPandas(walk, "a long, b long, depth int, label binary"))
    ends = found.filter("label is not null").select("a", F.explode(F.sequence(F.lit(least), F.lit(FULL_DEPTH))).alias("depth"), "label")
    ends = ends.select("a", "depth", F.expr("substring(label, 1, 1 + 2 * depth)").alias("prefix")).distinct()
    across = ends.join(ends.groupBy("prefix").agg(F.min("a").alias("b")), "prefix").select("a", "b", "depth")
    return found.filter("label is null").select("a", "b", "depth").union(across)


def cores(edges: DataFrame, large: int) -> DataFrame:
    """node, core, comp: components at the shortest match, and cores, which are those components, or for one of more than large texts those of the longest match within."""
    now = cut(components(edges).select("node", F.col("root").alias("comp")))
    over = cut(now.groupBy("comp").agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select("comp"))
    if over.isEmpty():
        return now.withColumn("core", F.col("comp"))
    inside = cut(now.join(over, "comp", "left_semi"))
    kept = edges.filter(F.col("depth") == FULL_DEPTH).join(inside, F.col("a") == F.col("node"), "left_semi")
    smaller = components(kept).select("node", F.col("root").alias("_core"))
    again = inside.join(smaller, "node", "left").select("node", "comp", F.coalesce("_core", "node").alias("core"))
    return cut(now.join(over, "comp", "left_anti").withColumn("core", F.col("comp")).unionByName(again))


def met_across(members: DataFrame, least: int) -> DataFrame:
    """(a, b), texts of different cores that meet in a bucket and agree in NEARLY minima; members has node, core and sig.

    Most texts of a bucket are of one core, so a bucket is dealt to blocks of these, and the others go to every block, and
    among them each to a block of its own. Only signatures are sent.
    """

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs = _signatures(batch["sig"])
            for tree in range(TREES):
                prefix = np.ascontiguousarray(sigs[:, _CHOICES[tree][:least]])
                yield pd.DataFrame({"bucket": [bytes([tree]) + p.tobytes() for p in prefix], "node": batch["node"].to_numpy(), "core": batch["core"].to_numpy(), "sig": batch["sig"].to_numpy()})

    labels = members.select("node", "core", "sig").mapInPandas(plant, "bucket binary, node long, core long, sig binary")
    by_core = labels.groupBy("bucket", "core").agg(F.count("*").alias("_n"))
    mixed = by_core.groupBy("bucket").agg(F.max(F.struct("_n", "core")).alias("_most"), F.count("*").alias("_cores")).filter("_cores > 1")
    mixed = mixed.select("bucket", F.col("_most.core").alias("main"), F.ceil(F.col("_most._n") / BLOCK).cast("int").alias("blocks"))
    rows = labels.join(mixed, "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a text of the main core is in one block; the others are in all, and meet one another in that of the lesser
    dealt = rows.withColumn("p", F.explode(F.when(F.col("core") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).withColumn("home", own)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []

        def done():
            main = [r for r in group if r[1] == r[3]]
            rest = [r for r in group if r[1] != r[3]]
            if not rest:
                return []
            right = [*main, *rest]
            sigs, cores, nodes = _signatures([r[2] for r in right]), np.array([r[1] for r in right]), np.array([r[0] for r in right])
            out = []
            for k, (node, core, _, _, home) in enumerate(rest):
                at = len(main) + k
                # pairs of others are looked at once, in the block of the first
                found = (np.arange(len(right)) < len(main)) | ((np.arange(len(right)) > at) & (home == key[1]))
                found &= (cores != core) & ((sigs == sigs[at]).sum(1) >= NEARLY)
                out += [(min(node, n), max(node, n)) for n in nodes[found].tolist()]
            return out

        for batch in batches:
            out = []
            for bucket, p, *row in batch.itertuples(index=False, name=None):
                if (bucket, p) != key:
                    if group:
                        out += done()
                    key, group = (bucket, p), []
                group.append(row)
            yield pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})
        if group:
            yield pd.DataFrame(done(), columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    dealt = dealt.select("bucket", "p", "node", "core", "sig", "main", "home").repartition("bucket", "p").sortWithinPartitions("bucket", "p", "node")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each text of left and each of right (numbers into sets) are alike enough, exactly."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    which = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    value, row = flat[order], which[order]
    new = np.r_[True, value[1:] != value[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for begin in range(0, int(column[-1]) + 1, COLUMNS):
            own = (column >= begin) & (column < begin + COLUMNS)
            m = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - begin)), np.float32)
            m[row[own], column[own] - begin] = 1
            common += m[left] @ m[right].T
    common = np.rint(common).astype(np.int64)
    either = n[left][:, None] + n[right][None, :] - common
    return OF * common >= ABOVE * either


def compared(nodes: list[int], sets: list[np.ndarray], sides: list[bool] | None) -> list[tuple[int, int, int]]:
    """(text, number of its links, least text it is connected to) for each text with links, from one group.

    sides: for a pair of different blocks, whether a text is of the second; only pairs across are compared.
    """
    ids = np.array(nodes)
    side = np.array(sides) if sides is not None else None
    left = np.arange(len(ids)) if side is None else np.flatnonzero(~side)
    right = np.arange(len(ids)) if side is None else np.flatnonzero(side)
    if not len(left) or not len(right):
        return []
    yes = _linked(sets, left, right)
    if side is None:
        np.fill_diagonal(yes, False)
    links = np.zeros(len(ids), np.int64)
    links[left] += yes.sum(1)
    if side is not None:
        links[right] += yes.sum(0)
    root = ids.copy()
    i, j = np.nonzero(yes)
    i, j = left[i], right[j]
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    return [(int(ids[k]), int(links[k]), int(root[k])) for k in np.flatnonzero(links)]


def with_grams(docs: DataFrame, members: DataFrame, repeat: bool) -> DataFrame:
    """For each of members (node, copy_id, key and core, blocks) its shingles: once, or with the pairs of blocks (core, p, q, second) that it is dealt to."""
    columns = "core long, p int, q int, second boolean, node long, grams binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            rows, held = [], 0
            for node, key, core, blocks, text in zip(*(batch[c] for c in ("node", "key", "core", "blocks", "text"))):
                words = shingler.words(text)
                if words_key(words) != key:
                    continue  # another text of the same id
                grams = np.unique(shingler.grams(words)).tobytes()
                own = xxhash.xxh3_64_intdigest(str(node)) % blocks
                rows += [(core, min(own, k), max(own, k), own > k, node, grams) for k in (range(blocks) if repeat else [own])]
                held += blocks * len(grams)
                if held > 1 << 24:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    texts = docs.select(F.col("doc_id").alias("copy_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(members, "copy_id").select("node", "key", "core", "blocks", "text").mapInPandas(deal, columns)


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, links and root by pair of blocks of each core; members has node, copy_id and key (which text it is), core and blocks."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []

        def done():
            rows = {r[1]: r for r in reversed(group)}
            if len(rows) < 2:
                return []
            sets = [np.frombuffer(r[2], np.uint64) for r in rows.values()]
            return compared(list(rows), sets, [r[0] for r in rows.values()] if key[1] != key[2] else None)

        for batch in batches:
            out = []
            for core, p, q, *row in batch.itertuples(index=False, name=None):
                if (core, p, q) != key:
                    out += done()
                    key, group = (core, p, q), []
                group.append(row)
            yield pd.DataFrame(out, columns=["node", "links", "root"])
        yield pd.DataFrame(done(), columns=["node", "links", "root"])

    dealt = with_grams(docs, members, True)
    return dealt.repartition("core", "p", "q").sortWithinPartitions("core", "p", "q").mapInPandas(compare, "node long, links long, root long")


def verified_pairs(docs: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, links and root of pairs (a, b) that are alike enough, both ways round."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node").withColumn("blocks", F.lit(1))
    grams = cut(with_grams(docs, met, False).select("node", "grams").dropDuplicates(["node"]))
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            common = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
            out.append(OF * common >= ABOVE * (len(p) // 8 + len(q) // 8 - common))
        return pd.Series(out, dtype=bool)

    ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).cast("long").alias("links"), F.col("a").alias("root")), F.struct(F.col("b").alias("node"), F.lit(1).cast("long").alias("links"), F.col("a").alias("root"))))
    return both.filter(alike("x", "y")).select(ways.alias("w")).select("w.*")


def linked_texts(docs: DataFrame, reps: DataFrame, large: int | None = None) -> DataFrame:
    """node, n_links and root (of its class) of every text that has links; reps has node, copy_id, key, n_words and sig."""
    least = matched_depth()
    edges = forest_edges(reps.filter("n_words > 0"), least)
    known = cut(cores(edges, LARGE if large is None else large).join(reps.select("node", "copy_id", "key", "n_words", "sig"), "node"))
    sizes = known.groupBy("core").agg(F.count("*").alias("_n"), F.sum("n_words").alias("_w")).filter("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_w") / BLOCK_WORDS)).cast("int")
    members = known.join(sizes.select("core", blocks.alias("blocks")), "core").select("node", "copy_id", "key", "core", "blocks")
    found = verified(docs, members)
    # components that were parted
    apart = cut(known.groupBy("comp").agg(F.min("core").alias("_a"), F.max("core").alias("_b")).filter("_a < _b").select("comp"))
    whole = apart.isEmpty()
    if not whole:
        parted = known.join(apart, "comp", "left_semi")
        met = cut(met_across(parted, least))
        found = found.unionByName(verified_pairs(docs, parted.select("node", "copy_id", "key", "core"), met))
    found = cut(found)
    # the links of one block are a class; those of several blocks or cores are joined
    many = members.filter("blocks > 1").select("node")
    if not whole:
        many = many.union(parted.select("node")).distinct()
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    joined = cut(components(found.join(many, "node", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return links.join(joined.select("node", F.col("root").alias("_far")), "node", "left").select("node", "n_links", F.coalesce("_far", "root").alias("root"))


def _texts(docs: DataFrame, large: int | None) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id and key; and for every key copy_id, n_copies, n_links, and class_id and class_key, the least id and key of the class."""
    own = cut(docs.select("doc_id", signed(F.col("text")).alias("_s")).select("doc_id", "_s.*"))
    reps = own.filter("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n_words", "sig")).alias("_f"), F.count("*").alias("n_copies"))
    # written out, so that the numbers stay
    reps = cut(reps.select(F.monotonically_increasing_id().alias("node"), "key", F.col("_f.doc_id").alias("copy_id"), "_f.n_words", "_f.sig", "n_copies"))
    links = cut(linked_texts(docs, reps, large).join(reps.select("node", "copy_id", "key"), "node"))
    least = links.groupBy("root").agg(F.min(F.struct("copy_id", "key")).alias("_least"))
    classed = links.join(least, "root").select("node", "n_links", "_least")
    known = reps.join(classed, "node", "left").select(
        "key", "copy_id", "n_copies", F.coalesce("_least.copy_id", "copy_id").alias("class_id"), F.coalesce("_least.key", "key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return own.select("doc_id", "key"), cut(known)


def classes(docs: DataFrame, large: int | None = None) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), copy_id (the least of its copies), n_copies and n_links (different texts alike enough)."""
    own, known = _texts(docs, large)
    joined = own.filter("doc_id is not null").join(known, "key").select("doc_id", "class_id", "copy_id", "n_copies", "n_links")
    null = F.lit(None).cast("long")
    return joined.unionByName(own.filter("doc_id is null").select("doc_id", *(null.alias(c) for c in ("class_id", "copy_id", "n_copies", "n_links"))))


def one_of_each(docs: DataFrame, large: int | None = None) -> DataFrame:
    """The documents, one of each class: of its least id and key, the row that is least by its values. Rows without an id stay."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    _, known = _texts(docs, large)
    kept = known.filter("key = class_key").select(F.col("copy_id").alias("_id"), F.col("key").alias("_kept"))
    rows = docs.filter(F.col("doc_id").isNotNull()).withColumn(key, keyed(F.col("text")))
    chosen = rows.join(kept, (rows["doc_id"] == kept["_id"]) & (rows[key] == kept["_kept"]), "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()))
