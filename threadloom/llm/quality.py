"""Quality by co-training of two views: what a text says, and what is stored about its page.

The text view is a logistic model over a text's content alone: hashed lower-case words, their letter ends, and numbers of its
make-up (lines, marks, capitals, digits, variety, doubled words). The metadata view is a logistic model over the stored fields alone: language,
source and stated length. Each learns from the labelled sample and is calibrated on labelled documents apart.

In each round both views score all documents, in Spark, from features that are computed once and written out. A histogram of each
view's scores over all of them gives the bounds of its surest share, good and poor; it teaches no document that it is less
than SURE of. Of the documents beyond the bounds that have no label, at most TAUGHT of a kind, in the order of a hash, become
pseudo-labels of the other view, which is fitted anew. In the end the score of a document is the logistic of the views'
calibrated logits, weighed by how well each does apart. All documents' whole texts are scored.

Bounded are the labelled sample (MAX_GOOD, MAX_BAD), the pseudo-labels fitted on (TAUGHT) and the models' size; bounds of the
surest share come from all documents.

Defined results: a null text is empty and null metadata are values of their own; without labels of both kinds all scores are
1; repeated rows have equal scores; a text of any length is read whole, in time in proportion to it; an empty table gives no
rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_share, labelled_sample, slices

MAX_GOOD, MAX_BAD = 1500, 1000
#: Rounds, the share of all documents that a view may teach, how sure it must be, and the pseudo-labels of a kind that are fitted on.
ROUNDS, SHARE, SURE, TAUGHT = 2, 0.05, 0.9, 500
ROWS, LANGUAGES, SOURCES, BINS = 1 << 14, 16, 64, 1000
#: Words whose rows a worker keeps.
MAX_WORDS = 300_000

META = ("lang", "source", "n_chars")
CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
MARKS = re.compile(r"[^\w\s]")
DIGITS = re.compile(r"\d")


def packed_bytes(text: str) -> int:
    """How long the whole text is when deflated, a chunk at a time."""
    z = zlib.compressobj(1)
    return sum(len(z.compress(text[i : i + 65_536].encode())) for i in range(0, len(text), 65_536)) + len(z.flush())


def layout(text: str) -> list[float]:
    """Numbers of a text's make-up."""
    n = max(1, len(text))
    lines = text.split("\n")
    words = text.split()
    packed = packed_bytes(text) / n if text else 0.0
    return [
        np.log1p(len(text)), np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(len(words)), len(set(words)) / max(1, len(words)), sum(map(len, words)) / max(1, len(words)) / 10,
        sum(map(operator.eq, words, words[1:])) / max(1, len(words)) * 10, len(CAPITALS.findall(text)) / n, len(MARKS.findall(text)) / n, len(DIGITS.findall(text)) / n, text.count("!") / n * 10, text.count("|") / n * 10, packed,
    ]


def page(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """The metadata view's numbers: buckets of language and source, the stated length and its power of two, and what is missing."""
    none = n_chars is None or n_chars != n_chars
    size = 0.0 if none else float(np.log2(1 + max(0.0, float(n_chars))))
    buckets = np.zeros(LANGUAGES + SOURCES + 24)
    buckets[zlib.crc32((lang or "").encode()) % LANGUAGES] = 1.0
    buckets[LANGUAGES + zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    buckets[LANGUAGES + SOURCES + min(23, int(size))] = 1.0
    return [size, float(lang is None), float(source is None), float(none), *buckets]


class Words:
    """Rows of words, remembered up to a bound."""

    def __init__(self):
        self.rows: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> np.ndarray:
        """The rows of a text's words and of their last three letters."""
        rows, out = self.rows, []
        if len(rows) > MAX_WORDS:
            rows.clear()
        for w in text.split():
            pair = rows.get(w)
            if pair is None:
                low = w.lower()
                pair = rows[w] = (zlib.crc32(low.encode()) % ROWS, ROWS + zlib.crc32(("~" + w[-3:]).encode()) % ROWS)
            out += pair
        return np.array(out, dtype=np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * np.asarray(x)) + 0.5


class Scaled:
    """Numbers, standardised as those of the fit, with their squares."""

    def __init__(self, x: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([z, z * z], axis=1)


class TextView:
    """Logistic over the share of each row among a text's words, scaled, and the numbers of its make-up."""

    def __init__(self):
        self.weights, self.level, self.scaled, self.at = np.zeros(2 * ROWS), 0.0, None, None

    def _total(self, rows: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(r) for r in rows], dtype=np.int64)
        which = np.repeat(np.arange(len(rows)), n)
        total = np.bincount(which, self.weights[np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)], len(rows))
        return total / np.sqrt(np.maximum(n, 1)) + self.level

    def logits(self, rows: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        return self._total(rows) + self.scaled(numbers) @ self.at if rows else np.zeros(0)

    def fit(self, rows: list[np.ndarray], numbers: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> None:
        n = np.array([len(r) for r in rows])
        which, flat = np.repeat(np.arange(len(rows)), n), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        scale = 1 / np.sqrt(np.maximum(n, 1))
        self.scaled = Scaled(numbers)
        wide = self.scaled(numbers)
        self.weights, self.level, self.at = np.zeros(2 * ROWS), 0.0, np.zeros(wide.shape[1])
        mean, square = np.zeros(2 * ROWS + 1 + len(self.at)), np.zeros(2 * ROWS + 1 + len(self.at))
        for step in range(1, steps + 1):
            error = weight * (sigmoid(self._total(rows) + wide @ self.at) - y) / weight.sum()
            g = np.concatenate([np.bincount(flat, (error * scale)[which], 2 * ROWS) + 1e-5 * self.weights, [error.sum()], wide.T @ error + 1e-3 * self.at])
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            self.weights -= move[: 2 * ROWS]
            self.level -= move[2 * ROWS]
            self.at -= move[2 * ROWS + 1 :]


class MetaView:
    """Logistic over the stored fields."""

    def __init__(self):
        self.scaled = self.at = None

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.scaled(x), np.ones((len(x), 1))], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._wide(x) @ self.at if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.scaled = Scaled(x)
        wide = self._wide(x)
        self.at = np.zeros(wide.shape[1])
        ridge = 1e-2 * len(x) * np.eye(wide.shape[1])
        for _ in range(25):
            p = sigmoid(np.clip(wide @ self.at, -20, 20))
            slope = wide.T @ (weight * (p - y)) + ridge @ self.at
            curve = (wide * (weight * p * (1 - p))[:, None]).T @ wide + ridge
            move = np.linalg.solve(curve, slope)
            self.at = self.at - move * min(1.0, 4 / max(1e-9, np.abs(move).max()))


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, both kinds weighing alike, kept from running off by a ridge."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    scale = max(1e-6, np.abs(logits).mean())
    x = np.stack([logits / scale, np.ones_like(logits)], axis=1)
    at = np.zeros(2)
    for _ in range(40):
        p = sigmoid(np.clip(x @ at, -30, 30))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (weight * (p - y)) + 0.5 * at)
        at = at - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(at[0] / scale), float(at[1])


class Features:
    """Of some documents: rows of words, numbers of the make-up, and numbers of the page."""

    def __init__(self, rows: list[np.ndarray], numbers: np.ndarray, pages: np.ndarray):
        self.rows, self.numbers, self.pages = rows, numbers, pages

    @classmethod
    def of(cls, frame: pd.DataFrame, words: Words) -> Features:
        texts = ["" if t is None else t for t in frame["text"]]
        meta = zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in META))
        pages = np.array([page(*m) for m in meta], float)
        return cls([words.of(t) for t in texts], np.array([layout(t) for t in texts], float).reshape(len(texts), -1), pages.reshape(len(texts), -1))

    @classmethod
    def read(cls, rows, numbers, pages) -> Features:
        """From what features() stores."""
        n = len(rows)
        return cls([np.frombuffer(r, np.uint16) for r in rows], np.frombuffer(b"".join(numbers), np.float32).reshape(n, -1).astype(float), np.frombuffer(b"".join(pages), np.float32).reshape(n, -1).astype(float))

    def part(self, chosen: np.ndarray) -> Features:
        return Features([self.rows[i] for i in np.flatnonzero(chosen)], self.numbers[chosen], self.pages[chosen])

    def plus(self, other: Features) -> Features:
        return Features([*self.rows, *other.rows], np.concatenate([self.numbers, other.numbers]), np.concatenate([self.pages, other.pages])) if len(other.rows) else self


class Model:
    """Both views, their calibrations and their weights."""

    def __init__(self, text: TextView | None, meta: MetaView | None, calibrations=((1.0, 0.0), (1.0, 0.0)), weights=(0.5, 0.5)):
        self.text, self.meta, self.calibrations, self.weights = text, meta, calibrations, weights

    def logits(self, own: Features) -> list[np.ndarray]:
        """The calibrated logits of both views."""
        parts = self.text.logits(own.rows, own.numbers), self.meta.logits(own.pages)
        return [np.clip(a * x + b, -20, 20) for (a, b), x in zip(self.calibrations, parts)]

    def scores(self, own: Features) -> np.ndarray:
        if self.text is None:
            return np.ones(len(own.rows))
        return sigmoid(sum(w * x for w, x in zip(self.weights, self.logits(own))))


def features(docs: DataFrame) -> DataFrame:
    """pid (a number of the row), doc_id, h (a hash of the text) and the features of every document, written out."""

    @F.pandas_udf("rows binary, numbers binary, pages binary")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            frame, out = pd.DataFrame(dict(zip(("text", *META), batch))), []
            for a, b in slices([len(t or "") for t in frame["text"]]):
                own = Features.of(frame.iloc[a:b], words)
                out += [(r.astype(np.uint16).tobytes(), n.tobytes(), p.tobytes()) for r, n, p in zip(own.rows, own.numbers.astype(np.float32), own.pages.astype(np.float32))]
            yield pd.DataFrame(out, columns=["rows", "numbers", "pages"])

    own = docs.select("doc_id", F.xxhash64("text").alias("h"), run(*(F.col(c) for c in ("text", *META))).alias("_f"))
    return cut(own.select(F.monotonically_increasing_id().alias("pid"), "doc_id", "h", "_f.*"))


def surest(bins: dict[int, int], good: float) -> tuple[float, float]:
    """Bounds of the surest share of a view: documents at or below the first are poor, at or above the second good; bins counts scores in steps of 1 / BINS."""
    total = sum(bins.values())
    low, seen = -1.0, 0
    for b in sorted(bins):
        seen += bins[b]
        if seen > SHARE * (1 - good) * total and low >= 0:
            break
        low = (b + 1) / BINS
    high, seen = 2.0, 0
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if seen > SHARE * good * total and high <= 1:
            break
        high = b / BINS
    return min(low, 1 - SURE), max(high, SURE)


def taught(pool: DataFrame, labels: DataFrame, model: Model, good: float, turn: int) -> list[tuple[Features, np.ndarray]]:
    """For each view what it is surest of among all documents without a label: at most TAUGHT of each kind, distinct in text."""

    @F.pandas_udf("text double, meta double")
    def run(rows: pd.Series, numbers: pd.Series, pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("text", "meta"), map(sigmoid, model.logits(Features.read(rows, numbers, pages))))))

    scores = cut(pool.select("pid", "doc_id", "h", run("rows", "numbers", "pages").alias("_s")).select("pid", "doc_id", "h", "_s.*"))
    out = []
    for view in ("text", "meta"):
        bins = {r["b"]: r["n"] for r in scores.groupBy(F.floor(F.col(view) * BINS).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
        low, high = surest(bins, good)
        ids = None
        for y, inside, n in ((0, F.col(view) <= low, sum(v for b, v in bins.items() if b / BINS <= low)), (1, F.col(view) >= high, sum(v for b, v in bins.items() if b / BINS >= high))):
            own = scores.filter(inside & hash_share(F.col("pid") + turn, 8 * TAUGHT, n)).join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
            own = own.groupBy("h").agg(F.min("pid").alias("pid")).orderBy(F.xxhash64(F.col("h") + turn), "h").limit(TAUGHT).select("pid", F.lit(y).alias("y"))
            ids = own if ids is None else ids.unionByName(own)
        found = pool.join(F.broadcast(ids), "pid").select("pid", "rows", "numbers", "pages", "y").toPandas().sort_values("pid")
        out.append((Features.read(found["rows"], found["numbers"], found["pages"]) if len(found) else Features([], np.zeros((0, 0)), np.zeros((0, 0))), found["y"].to_numpy(float)))
    return out


def fitted(own: Features, y: np.ndarray, apart: np.ndarray, extra: list[tuple[Features, np.ndarray]]) -> Model:
    """Both views fitted on labels and on what the other view teaches, calibrated and weighed on the labels apart."""
    text, meta, good = TextView(), MetaView(), y.mean()
    known, labels = own.part(~apart), y[~apart]
    for view, (more, said) in ((text, extra[1]), (meta, extra[0])):
        both, target = known.plus(more), np.concatenate([labels, said])
        # kinds weigh alike, and a pseudo-label half as much as a label
        weight = np.where(target == 1, 0.5 / max(good, 1e-3), 0.5 / max(1 - good, 1e-3)) * np.r_[np.ones(len(labels)), np.full(len(said), 0.5)]
        if view is text:
            view.fit(both.rows, both.numbers, target, weight)
        else:
            view.fit(both.pages, target, weight)
    check = apart if apart.any() else ~apart
    held, truth = own.part(check), y[check]
    raw = [text.logits(held.rows, held.numbers), meta.logits(held.pages)]
    calibrations = tuple(calibrated(x, truth) for x in raw)
    right = []
    for (a, b), x in zip(calibrations, raw):
        said = sigmoid(np.clip(a * x + b, -20, 20)) >= 0.5
        right.append(max(0.0, (said[truth == 1].mean() + 1 - said[truth == 0].mean()) / 2 - 0.5) + 1e-3)
    return Model(text, meta, calibrations, (right[0] / sum(right), right[1] / sum(right)))


def fit(docs: DataFrame, labels: DataFrame, max_good: int = MAX_GOOD, max_bad: int = MAX_BAD, rounds: int = ROUNDS) -> Model:
    sample, _ = labelled_sample(docs, labels, "quality", {1: max_good, 0: max_bad}, ["text", *META], held_fold=False)
    y = sample["_label"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(None, None)
    own = Features.of(sample, Words())
    apart = np.array([zlib.crc32(str(i).encode()) % 4 == 1 for i in sample["doc_id"]])
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    none = Features([], np.zeros((0, 0)), np.zeros((0, 0))), np.zeros(0)
    extra = [none, none]
    model, pool = fitted(own, y, apart, extra), features(docs)
    for turn in range(rounds):
        new = taught(pool, labels, model, y.mean(), turn)
        extra = [(a.plus(b) if len(a.rows) else b, np.concatenate([said, more])) for (a, said), (b, more) in zip(extra, new)]
        model = fitted(own, y, apart, extra)
    return model


def score(docs: DataFrame, model: Model) -> Column:
    """The score, from a table's own columns."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words = Words()
        for batch in batches:
            frame = pd.DataFrame(dict(zip(("text", *META), batch)))
            out = [np.zeros(0)]
            for a, b in slices([len(t or "") for t in frame["text"]]):
                out.append(model.scores(Features.of(frame.iloc[a:b], words)))
            yield pd.Series(np.concatenate(out))

    return run(docs["text"], docs["lang"], docs["source"], docs["n_chars"])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and good (1 if the score is at least 0.5) of every document."""
    model = fit(docs, labels)
    own = docs.select("doc_id", "text", *META)
    return own.select("doc_id", score(own, model).alias("score")).withColumn("good", (F.col("score") >= 0.5).cast("int"))
