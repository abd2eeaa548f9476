"""Personal data: wide candidate generators, boosted trees over format and context, calibrated thresholds by kind.

Base spans follow fixed patterns and checks and always stay. Generators with high recall propose more spans, which overlap:
addresses with "at" and "dot" spelled out or spaced, dotted numbers in brackets or with spaces, cards with odd separators,
telephone numbers without a plus. Trees tell real ones from look-alikes. What real ones look like in such forms is taught by
slips: in the surroundings of base spans of the corpus, the span is written in a form that the base patterns don't read
(label 1), and beside it a look-alike of the same shape that can't be real (a wrong check digit, a part above 255, a year
range, prose; label 0). Candidates of the corpus that aren't base spans are of label 1 only if they are spelled in brackets
and read as a base span when written plainly; all others are of label 0, so numbers that fail the check digit are left alone.

Thresholds by kind are set on all documents but those that the trees were fitted on, as the least probability, in steps of
1 / PARTS, above which PRECISION of the candidates are real; Spark counts candidates by step. The corpus's own candidates weigh
as their number over all documents, and slips as SLIPS times the number of base spans of their kind. Below MIN_SEEN slips
nothing is added for the kind.

The trees are fitted on at most MAX_DOCS distinct texts, picked by hash, and MAX_EACH candidates of a kind and label in each;
all documents' whole texts are then searched, row by row, without a shuffle.

Defined results: a null text is empty and has no spans; equal texts have equal spans; positions are code points, ends
exclusive; spans that the trees add don't overlap base spans or one another, the likelier one stays and then the first; a text
of any length takes time in proportion to it; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, slices
from .trees import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Texts whose candidates train the trees, and candidates of each kind and label in one of them.
MAX_DOCS, MAX_EACH = 4000, 8
#: What is asked of a threshold and its least value, the share of slips assumed among base spans, and the slips it must be seen on.
PRECISION, LEAST, SLIPS, MIN_SEEN = 0.97, 0.5, 0.1, 12
#: Steps of the probabilities that are counted.
PARTS = 1000
#: Characters around a candidate that its features look at.
NEAR = 24

Span = tuple[str, int, int]

# An address's first part is what stands before the @, so it is found backwards from there; a search forward would try every
# letter of a long text anew.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# In a run of digits only the first can begin a match, since the rest of the pattern doesn't depend on where the run begins.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Addresses are found from what stands for the @, backwards and forwards.
AT = re.compile(r" ?(?:@|\(at\)|\[at\]|\{at\}) ?| at ")
DOT = r"(?:\.| \. | dot | ?(?:\(dot\)|\[dot\]|\{dot\}) ?)"
SITE = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[ ()._/-]{0,3}[0-9]){6,24}(?![0-9])")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:[.,]| \. |\[\.\]|\(\.\)| dot |\(dot\)|\[dot\])[0-9]{1,3}){3}(?![0-9])")
BRACKETED = re.compile(r"[\[({](?:at|dot|\.)[\])}]")
WORDS = {
    "email": ("mail", "contact", "write", "adress", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "pay", "credit", "carte"),
    "phone": ("call", "phone", "tel", "fax", "mobile"),
}


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            out.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by place."""
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def spelled_addresses(text: str) -> Iterator[Span]:
    for m in AT.finditer(text):
        begin, least = m.start(), max(0, m.start() - 64)
        while begin > least and LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < m.start() and (site := SITE.match(text, m.end())):
            yield "email", begin, site.end()


def candidates(text: str) -> Iterator[Span]:
    """What the wide generators propose, base spans among it."""
    yield from spelled_addresses(text)
    for m in DOTTED.finditer(text):
        yield "ip", *m.span()
    for m in NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if 16 <= n <= 19:
            yield "card", *m.span()
        if 8 <= n <= 15:
            yield "phone", *m.span()


class Intervals:
    """Intervals that don't overlap, or whose overlaps don't matter, kept in order."""

    def __init__(self, spans: list[Span]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.begins.append(a)
                self.ends.append(b)

    def meet(self, begin: int, end: int) -> bool:
        i = bisect.bisect_left(self.begins, end)
        return i > 0 and self.ends[i - 1] > begin


def beside_base(text: str, base: list[Span]) -> list[Span]:
    """Candidates that meet no base span."""
    held = Intervals(base)
    return [s for s in dict.fromkeys(candidates(text)) if not held.meet(s[1], s[2])]


def plainly(own: str) -> str:
    """A bracketed spelling, written plainly."""
    return re.sub(r" ?[\[({](?:dot|\.)[\])}] ?", ".", re.sub(r" ?[\[({]at[\])}] ?", "@", own))


def features(text: str, span: Span) -> list[float]:
    """Format, checks and context of a candidate."""
    kind, begin, end = span
    own, left, right = text[begin:end], text[max(0, begin - NEAR) : begin], text[end : end + NEAR]
    digits = re.findall("[0-9]+", own)
    groups, whole = [len(g) for g in digits] or [0], "".join(digits)
    near = (left + " " + right).lower()
    site = re.split(r"@|\bat\b", own)[-1]
    return [
        KINDS.index(kind), len(own), len(whole), len(groups), max(groups), min(groups), groups[0], groups[-1], len(set(groups)),
        own.count(" "), own.count("-"), own.count("."), own.count("(") + own.count(")"), own.count("/") + own.count("_"), own.count(","), own.startswith("+"), own.count("  "),
        len(BRACKETED.findall(own)), own.count(" dot "), own.count(" at "), own.count("@"), own.count(" . ") + own.count(" @ "),
        sum(c.isalpha() for c in own), len(re.split(r"[^A-Za-z]+", own)[-1]), site != site.lower(), 16 <= len(whole) <= 19 and luhn(whole), all(int(g[:4]) <= 255 for g in digits),
        whole[:1] == "0", whole[:2] in ("19", "20"), len(set(whole)),
        left[-1:].isalnum(), right[:1].isalnum(), left[-1:].isspace() or not left, right[:1].isspace() or not right,
        sum(c in "#*$%&|<>{}[]\"'=" for c in left + right), sum(c.isdigit() for c in left + right), any(w in near for w in WORDS[kind]),
    ]


def slipped(kind: str, own: str, rng: random.Random) -> tuple[str, str]:
    """A base span's text in a form that the base patterns don't read, and a look-alike that isn't real."""
    whole = "".join(c for c in own if c.isdigit())
    if kind == "email":
        local, _, site = own.partition("@")
        at = rng.choice([" at ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " @ "])
        dot = rng.choice([" dot ", "(dot)", " (dot) ", "[dot]", " [dot] "] + (["."] if at != " at " else []))
        if rng.random() < 0.5 and re.search("[a-z]", local):
            local, site = re.sub("[0-9]", "", local).strip("._-"), re.sub("[0-9]", "", site)
        word = re.sub("[^a-z]", "", local.lower()) or "look"
        return local + at + site.replace(".", dot), rng.choice([f"{word} at the {word}. The", f"{word} at {word}.The", f"{word} @ {word}. And", f"{word} at {word}. {word.title()}"])
    if kind == "ip":
        sep = rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"])
        parts = own.split(".")
        wrong = [str(rng.randrange(256, 1000)) if i == rng.randrange(4) or rng.random() < 0.4 else p for i, p in enumerate(parts)]
        wrong[rng.randrange(4)] = str(rng.randrange(256, 1000))
        return sep.join(parts), rng.choice([sep.join(wrong), ",".join(wrong), ",".join(parts), ".".join(wrong)])
    if kind == "card":
        sep = rng.choice([".", "_", "/", "  ", " - ", ". "])
        cut = lambda d, s: s.join(d[i : i + 4] for i in range(0, len(d), 4))
        i = rng.randrange(len(whole))
        wrong = whole[:i] + str((int(whole[i]) + rng.randrange(1, 10)) % 10) + whole[i + 1 :]
        wrong = wrong if not luhn(wrong) else whole[:-1] + str((int(whole[-1]) + 1) % 10)
        return cut(whole, sep), rng.choice([cut(wrong, sep), cut(wrong, " "), wrong, wrong])
    tail = own[1:].lstrip()
    bare = re.sub(r"^[0-9]{1,3}[ .-]", "", tail)
    year = rng.randrange(1950, 2030)
    real = [tail if len(re.findall("[0-9]+", tail)) > 2 else f"00 {tail}", "00" + tail, bare if len(re.findall("[0-9]", bare)) > 8 and not bare.isdigit() else "00" + tail, re.sub(r"[() -]+", "/", "0" + tail)]
    return rng.choice(real), rng.choice([f"{year}-{year + 1}", f"{year} - {year + 4}", whole, whole[:8], f"{year}-01-02 10.20", f"978-{whole[:1]}-{(whole * 2)[:2]}-{(whole * 3)[:6]}-{whole[-1]}", f"{whole[:3]} {whole[3:6]} {whole[6:9]}0"])


def examples(text: str, max_each: int = MAX_EACH) -> list[tuple[str, int, bool, list[float]]]:
    """(kind, label, of the corpus, features): the text's own candidates, and slips and look-alikes in its base spans' places."""
    base = base_spans(text)
    seen: Counter = Counter()
    out = []

    def add(kind: str, label: int, own: bool, where: str, span: Span):
        seen[kind, label, own] += 1
        if seen[kind, label, own] <= max_each:
            out.append((kind, label, own, features(where, span)))

    for span in beside_base(text, base):
        add(span[0], natural_label(text, span), True, text, span)
    for kind, begin, end in base:
        rng = random.Random(zlib.crc32(text[begin:end].encode()) + begin)
        left, right = text[max(0, begin - NEAR) : begin], text[end : end + NEAR]
        for label, form in zip((1, 0), slipped(kind, text[begin:end], rng)):
            where, whole = left + form + right, (len(left), len(left) + len(form))
            for span in beside_base(where, base_spans(where)):
                # a part of a slip isn't what should be found
                if span[1] < whole[1] and whole[0] < span[2]:
                    add(span[0], int(label and span == (kind, *whole)), False, where, span)
    return out


def natural_label(text: str, span: Span) -> int:
    kind, begin, end = span
    own = text[begin:end]
    return int(bool(BRACKETED.search(own)) and base_spans(plain := plainly(own)) == [(kind, 0, len(plain))])


class Finder:
    """Trees and thresholds; without trees only base spans are found."""

    def __init__(self, trees: BoostedTrees | None, bounds: dict[str, float]):
        self.trees, self.bounds = trees, bounds

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """For each text its base spans and all its spans."""
        bases = [base_spans(t) for t in texts]
        asked: list[tuple[int, Span]] = []
        rows: list[list[float]] = []
        if self.trees is not None and self.bounds:
            for k, (text, base) in enumerate(zip(texts, bases)):
                for span in beside_base(text, base):
                    if span[0] in self.bounds:
                        asked.append((k, span))
                        rows.append(features(text, span))
        out = [(b, list(b)) for b in bases]
        if rows:
            likely = self.trees.predict(np.array(rows, float))
            chosen = sorted((k, s[1], s[2], -p, s) for (k, s), p in zip(asked, likely) if p >= self.bounds[s[0]])
            cluster: list[tuple] = []
            for row in [*chosen, None]:
                if cluster and (row is None or row[0] != cluster[0][0] or row[1] >= max(c[2] for c in cluster)):
                    # of candidates that overlap one another, the likeliest, then what it leaves free
                    taken: list[Span] = []
                    for c in sorted(cluster, key=lambda c: c[3:]):
                        if not any(c[1] < e and b < c[2] for _, b, e in taken):
                            taken.append(c[4])
                    out[cluster[0][0]][1].extend(taken)
                    cluster = []
                if row is not None:
                    cluster.append(row)
        for _, spans in out:
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        return out


def _bound(likely: np.ndarray, real: np.ndarray, n: np.ndarray, weight: np.ndarray) -> float | None:
    """The least probability at and above which PRECISION of the weighed candidates are real; None if too few are seen. A row stands for n candidates."""
    order = np.argsort(-likely, kind="stable")
    right, every, seen = np.cumsum((real * weight)[order]), np.cumsum(weight[order]), np.cumsum((real * n)[order])
    last = np.flatnonzero(np.r_[np.diff(likely[order]) != 0, True])
    good = [i for i in last if right[i] >= PRECISION * every[i] and seen[i] >= MIN_SEEN]
    return max(LEAST, float(likely[order][good[-1]])) if good else None


def judged(docs: DataFrame, trees: BoostedTrees, trained: set[int]) -> dict[tuple[str, int, bool, int], int]:
    """How many examples all documents have by kind, label, whether of the corpus, and probability in steps of 1 / PARTS.

    The step is -1 in texts that the trees were fitted on, by hash; base spans have label 2 and step -1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for a, b in slices([len(t) for t in batch["text"]]):
                keys, rows = [], []
                for h, text in zip(batch["h"][a:b], batch["text"][a:b]):
                    base = base_spans(text)
                    n.update((s[0], 2, True, -1) for s in base)
                    if h in trained:
                        n.update((s[0], natural_label(text, s), True, -1) for s in beside_base(text, base))
                        continue
                    for *key, x in examples(text, len(text) + 1):
                        keys.append(key)
                        rows.append(x)
                if rows:
                    steps = np.floor(trees.predict(np.array(rows, float)) * PARTS).astype(int).tolist()
                    n.update((*key, step) for key, step in zip(keys, steps))
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "label", "own", "step", "n"])

    own = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").rlike(r"[0-9@]| at |[\[({]at[\])}]"))
    cells = own.mapInPandas(run, "kind string, label int, own boolean, step int, n long").groupBy("kind", "label", "own", "step")
    return {(r["kind"], r["label"], r["own"], r["step"]): r["n"] for r in cells.agg(F.sum("n").alias("n")).collect()}


def bounds_of(cells: dict[tuple[str, int, bool, int], int]) -> dict[str, float]:
    """The kinds' thresholds, from what judged() counts."""
    bounds = {}
    for kind in KINDS:
        own = [(label, real, step, n) for (k, label, real, step), n in cells.items() if k == kind and label < 2 and step >= 0]
        if not own:
            continue
        # what stands for the corpus's own candidates weighs as they all do, and slips as their share of base spans
        totals: Counter = Counter()
        for (k, label, real, _), n in cells.items():
            if k == kind and label < 2 and real:
                totals[label, True] += n
        seen: Counter = Counter()
        for label, real, _, n in own:
            seen[label, real] += n
        totals |= {(label, False): SLIPS * cells.get((kind, 2, True, -1), 0) for label in (0, 1)}
        label, real, step, n = zip(*own)
        weight = np.array([totals[g] / seen[g] * k for g, k in zip(zip(label, real), n)])
        if (bound := _bound(np.array(step) / PARTS, np.array(label, float), np.array(n), weight)) is not None:
            bounds[kind] = bound
    return bounds


def sampled(docs: DataFrame, limit: int) -> DataFrame:
    """At most limit distinct texts that may hold something, as h (their hash) and text; only hashes pass through one task."""
    # about one document in ten has digits; twice as many as that takes are looked at
    own = docs.select("text", F.xxhash64("text").alias("h")).filter(hash_share(F.col("h"), 20 * limit, docs.count()) & F.col("text").rlike("[0-9@]"))
    ids = own.select("h").distinct().orderBy("h").limit(limit)
    return own.join(F.broadcast(ids), "h").groupBy("h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_each: int = MAX_EACH) -> Finder:
    """Trees from the candidates of at most max_docs texts, but for a quarter of these; bounds from all documents that the trees weren't fitted on."""

    @F.pandas_udf("array<struct<kind:string,label:int,own:boolean,x:array<double>>>")
    def propose(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "label", "own", "x"), e)) for e in examples(t, max_each)] for t in texts])

    each = sampled(docs, max_docs).select("h", F.explode(propose("text")).alias("c")).select(F.pmod("h", F.lit(4)).alias("part"), "h", "c.*")
    found = each.toPandas().sort_values("h", kind="stable")
    apart = (found["part"] == 0).to_numpy()
    y = found["label"].to_numpy(float)
    if len(found) < 40 or apart.all() or not apart.any() or len(set(y[~apart])) < 2:
        return Finder(None, {})
    x = np.array(found["x"].tolist(), float)
    trees = BoostedTrees(trees=100, depth=5).fit(x[~apart], y[~apart])
    return Finder(trees, bounds_of(judged(docs, trees, set(found["h"][~apart].tolist()))))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def digest(text: Column, finder: Finder) -> Column:
    """Counts and hash of the base spans, and all spans."""

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = ["" if t is None else t for t in batch], []
            for a, b in slices([len(t) for t in texts]):
                for base, spans in finder.find(texts[a:b]):
                    rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans), len(spans) - len(base)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return run(text)


def redacted(text: Column, finder: Finder) -> Column:
    """The text with each span, or run of overlapping ones, replaced by its kind in square brackets; null stays null."""

    def cover(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if begin >= done:
                out += [text[done:begin], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = ["" if t is None else t for t in batch], []
            for a, b in slices([len(t) for t in texts]):
                out += [cover(t, spans) for t, (_, spans) in zip(texts[a:b], finder.find(texts[a:b]))]
            yield pd.Series([None if t is None else o for t, o in zip(batch, out)], dtype=object)

    return run(text)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every document."""
    return docs.select("doc_id", digest(F.col("text"), fit(docs)).alias("_d")).select("doc_id", "_d.*")
