"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their letters, in numpy.

A word's input is its own hashed embedding beside the mean of its hashed letter trigrams' embeddings. Overlapping windows of
words run through the network in both directions; attention pools the states, and a window's logit comes of the pooled state.
A document's logit is its highest window's. In training the windows of a document share its label softly, by their logits;
documents apart give the logit that parts the kinds with the fewest errors, which becomes the score 0.5. All windows of whole texts are scored.

The training sample is bounded: MAX_TOXIC and MAX_CLEAN labelled documents, none of the held-out fifth. Its documents go to
the driver, and the trained network, of fixed size, to the tasks. Labels, language, source and number are never inputs.

Defined results: a null or empty text, or one without words, is one empty window and has that window's score; without labels
of both kinds every score is 0; repeated rows have equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices

MAX_TOXIC, MAX_CLEAN = 1200, 2000
WINDOW, STRIDE = 64, 48
WORD_ROWS, LETTER_ROWS, WIDTH, HIDDEN, ATTENTION = 1 << 16, 1 << 13, 16, 12, 8
STEPS, DOCS_A_STEP, RATE, SEED = 200, 24, 0.02, 7
#: Windows of a document in a training step.
STEP_WINDOWS = 48
#: Rows of embeddings are learned if so many documents of the sample have them; the others stay zero.
LEAST_DOCS = 5
#: Documents' worth of doubt in the evidence that a row starts with, and the share of words whose own embedding is hidden in a step.
DOUBT, HIDDEN_WORDS = 10.0, 0.2
#: Words whose inputs a worker keeps, and windows that run at a time.
MAX_WORDS, RUN = 150_000, 4096

WORD = re.compile(r"[^\W_]+")


def windows_of(n: int) -> list[tuple[int, int]]:
    """Ranges of words, each WINDOW long or up to the end, begun every STRIDE; an empty text has an empty one."""
    last = max(0, n - WINDOW + STRIDE - 1) // STRIDE
    return [(k * STRIDE, min(n, k * STRIDE + WINDOW)) for k in range(last + 1)]


def word_row(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_ROWS


def letter_rows(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + 3].encode()) % LETTER_ROWS for i in range(max(1, len(marked) - 2))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, the forward pass, and the gradients of training."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * WIDTH
        scale = {"words": 0.1, "letters": 0.3}
        shapes = {"words": (WORD_ROWS, WIDTH), "letters": (LETTER_ROWS, WIDTH), "into": (d, 6 * h), "bias": (6 * h,), "back": (2, h, 3 * h), "look": (2 * h, ATTENTION), "key": (ATTENTION,), "out": (2 * h,), "level": (1,)}
        self.p = {k: (r.standard_normal(s) * scale.get(k, (s[-2] if len(s) > 1 else s[0]) ** -0.5)).astype(np.float32) for k, s in shapes.items()}
        self.p["bias"][:] = 0
        self.p["level"][:] = -1

    def inputs(self, words: list[str], shown: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Each distinct word's input to the gates of both directions, and what the gradients need. shown: 0 hides a word's own embedding."""
        own = np.array([word_row(w) for w in words], dtype=np.int64)
        letters = [letter_rows(w) for w in words]
        n = np.array([len(x) for x in letters])
        flat = np.array([i for x in letters for i in x], dtype=np.int64)
        starts = np.cumsum(n) - n
        mean = np.add.reduceat(self.p["letters"][flat], starts, axis=0) / n[:, None] if len(words) else np.zeros((0, WIDTH), np.float32)
        shown = np.ones(len(words), np.float32) if shown is None else shown
        x = np.concatenate([self.p["words"][own] * shown[:, None], mean], axis=1)
        return (x @ self.p["into"] + self.p["bias"]).astype(np.float32), (x, own, flat, n, shown)

    def forward(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. index, mask: time x window; rows of gates, and whether there is a word."""
        steps, many = index.shape
        h = HIDDEN
        states = np.zeros((steps, many, 2 * h), np.float32)
        past = []
        for way in (0, 1):
            u, state, trail = self.p["back"][way], np.zeros((many, h), np.float32), []
            part = np.ascontiguousarray(gates[:, way * 3 * h : (way + 1) * 3 * h])
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x, hu = part[index[t]], state @ u
                zr = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                m = mask[t][:, None]
                if keep:
                    trail.append((t, state, z, r, new, hu[:, 2 * h :], m))
                state = state + m * (1 - z) * (new - state)
                states[t, :, way * h : (way + 1) * h] = state
            past.append(trail)
        looked = np.tanh(states @ self.p["look"])
        weight = np.exp(looked @ self.p["key"]) * mask
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        pooled = (states * weight[:, :, None]).sum(0)
        logit = pooled @ self.p["out"] + self.p["level"]
        return logit, (states, past, looked, weight, pooled) if keep else None

    def gradients(self, gates, back, index, mask, kept, d_logit) -> dict[str, np.ndarray]:
        states, past, looked, weight, pooled = kept
        h = HIDDEN
        g = {"out": pooled.T @ d_logit, "level": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = (states * d_pool).sum(2)
        d_key = weight * (d_weight - (weight * d_weight).sum(0))
        g["key"] = np.einsum("tn,tna->a", d_key, looked)
        d_look = d_key[:, :, None] * self.p["key"] * (1 - looked**2)
        g["look"] = np.einsum("tnh,tna->ha", states, d_look)
        d_states += d_look @ self.p["look"].T
        d_gates = np.zeros((*index.shape, 6 * h), np.float32)
        g["back"] = np.zeros_like(self.p["back"])
        for way in (0, 1):
            u, d_state = self.p["back"][way], np.zeros((index.shape[1], h), np.float32)
            for t, state, z, r, new, hun, m in reversed(past[way]):
                d = d_state + d_states[t, :, way * h : (way + 1) * h]
                d_new = d * m * (1 - z) * (1 - new**2)
                d_z = -d * m * (new - state) * z * (1 - z)
                d_r = d_new * hun * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_gates[t, :, way * 3 * h : (way + 1) * 3 * h] = d_x
                g["back"][way] += state.T @ d_hu
                d_state = d * (1 - m * (1 - z)) + d_hu @ u.T
        x, own, flat, n, shown = back
        order = np.argsort(index, axis=None, kind="stable")
        rows = index.reshape(-1)[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        d_rows = np.zeros_like(gates)
        d_rows[rows[starts]] = np.add.reduceat(d_gates.reshape(-1, 6 * h)[order], starts, axis=0)
        g["into"], g["bias"] = x.T @ d_rows, d_rows.sum(0)
        d_x = d_rows @ self.p["into"].T
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], own, d_x[:, :WIDTH] * shown[:, None])
        g["letters"] = np.zeros_like(self.p["letters"])
        np.add.at(g["letters"], flat, np.repeat(d_x[:, WIDTH:] / n[:, None], n, axis=0))
        return g


def laid_out(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts of word numbers: index and mask, time x window, and each window's text."""
    spans = [(k, a, b) for k, words in enumerate(texts) for a, b in windows_of(len(words))]
    flat = np.array([w for words in texts for w in words] + [0], dtype=np.int64)
    first = np.cumsum([0, *map(len, texts)])
    begin = np.array([first[k] + a for k, a, _ in spans])
    length = np.array([b - a for _, a, b in spans])
    time = np.arange(WINDOW)[:, None]
    mask = (time < length).astype(np.float32)
    index = flat[np.minimum(begin + time, len(flat) - 1)] * (mask > 0)
    return index, mask, np.array([k for k, _, _ in spans])


def numbered(texts: list[str]) -> tuple[list[str], list[list[int]]]:
    """The distinct words of texts, after an empty one, and each text as numbers of them."""
    numbers: dict[str, int] = {"": 0}
    rows = [[numbers.setdefault(w, len(numbers)) for w in WORD.findall(t.lower())] for t in texts]
    return list(numbers), rows


def evidence(rows: Iterable[set[int]], labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the log odds of toxic documents among those that have it, against the sample's, and whether enough have it."""
    seen = np.zeros((2, size))
    for own, label in zip(rows, labels):
        seen[label, list(own)] += 1
    share = np.bincount(labels, minlength=2) / len(labels)
    odds = np.log((seen[1] + DOUBT * share[1]) / (seen[0] + DOUBT * share[0])) - np.log(share[1] / share[0])
    often = seen.sum(0) >= LEAST_DOCS
    return np.where(often, odds, 0).astype(np.float32), often


class Scorer:
    """A trained network with the logit that parts the kinds."""

    def __init__(self, network: Network | None, least: float = 0.0):
        self.network, self.least = network, least
        self.numbers: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def _rows(self, texts: list[str]) -> list[list[int]]:
        found = [WORD.findall(t.lower()) for t in texts]
        fresh = {w for words in found for w in words if w not in self.numbers}
        if not self.numbers or len(self.numbers) + len(fresh) > MAX_WORDS:
            self.numbers, fresh = {}, {"", *(w for words in found for w in words)}
            self.gates = np.zeros((MAX_WORDS // 4, 6 * HIDDEN), np.float32)
        if fresh:
            begin, words = len(self.numbers), sorted(fresh)
            self.numbers.update(zip(words, range(begin, begin + len(words))))
            if len(self.numbers) > len(self.gates):
                self.gates = np.concatenate([self.gates[:begin], np.zeros((len(words) + len(self.gates) // 2 + 1, 6 * HIDDEN), np.float32)])
            self.gates[begin : begin + len(words)] = self.network.inputs(words)[0]
        numbers = self.numbers
        return [[numbers[w] for w in words] for words in found]

    def logits(self, texts: list[str]) -> np.ndarray:
        index, mask, which = laid_out(self._rows(texts))
        each = np.concatenate([self.network.forward(self.gates, index[:, i : i + RUN], mask[:, i : i + RUN])[0] for i in range(0, index.shape[1], RUN)])
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, which, each)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None or not texts:
            return np.zeros(len(texts))
        return sigmoid(np.clip(self.logits(texts) - self.least, -30, 30))

    def __getstate__(self):
        return {"network": self.network, "least": self.least, "numbers": {}, "gates": self.gates[:0]}


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Network:
    """Adam over documents drawn so that both kinds are alike often."""
    network, r = Network(seed), np.random.default_rng(seed)
    kinds = [np.flatnonzero(labels == c) for c in (0, 1)]
    learned = {}
    of_words = {"words": lambda ws: {word_row(w) for w in ws}, "letters": lambda ws: {i for w in ws for i in letter_rows(w)}}
    for name, rows in of_words.items():
        odds, often = evidence((rows(set(WORD.findall(t.lower()))) for t in texts), labels, len(network.p[name]))
        network.p[name] *= often[:, None]
        # the first column starts as what the row's counts say
        network.p[name][:, 0] = odds / 2
        learned[name] = often[:, None]
    mean = {k: np.zeros_like(v) for k, v in network.p.items()}
    square = {k: np.zeros_like(v) for k, v in network.p.items()}
    queues: list[list[int]] = [[], []]
    for step in range(1, STEPS + 1):
        chosen = []
        for c in (0, 1):
            while len(queues[c]) < DOCS_A_STEP // 2:
                queues[c] += r.permutation(kinds[c]).tolist()
            chosen += queues[c][: DOCS_A_STEP // 2]
            del queues[c][: DOCS_A_STEP // 2]
        words, rows = numbered([texts[i] for i in chosen])
        index, mask, which = laid_out(rows)
        # a very long document is seen by some of its windows in a step, so that a step's memory is bounded
        some = np.concatenate([own if len(own) <= STEP_WINDOWS else np.sort(r.permutation(own)[:STEP_WINDOWS]) for own in (np.flatnonzero(which == k) for k in range(len(rows)))])
        index, mask, which = index[:, some], mask[:, some], which[some]
        gates, back = network.inputs(words, (r.random(len(words)) >= HIDDEN_WORDS).astype(np.float32))
        logit, kept = network.forward(gates, index, mask, keep=True)
        # a document's logit is the soft maximum of its windows'
        top = np.full(len(chosen), -np.inf)
        np.maximum.at(top, which, logit)
        share = np.exp(logit - top[which])
        total = np.bincount(which, share, len(chosen))
        share /= total[which]
        document = top + np.log(total / np.bincount(which, minlength=len(chosen)).clip(1) ** 0.5)
        error = (sigmoid(document) - labels[chosen]) / len(chosen)
        g = network.gradients(gates, back, index, mask, kept, (share * error[which]).astype(np.float32))
        norm = sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()) ** 0.5
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, x in g.items():
            if k in learned:
                x *= learned[k]
            x = x * min(1.0, 1.0 / max(norm, 1e-9))
            mean[k] += 0.1 * (x - mean[k])
            square[k] += 0.01 * (x * x - square[k])
            network.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def bound(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The logit that parts the kinds with the least weight of errors; in the middle of the widest gap if several do."""
    order = np.argsort(logits, kind="stable")
    x, toxic = logits[order], labels[order] == 1
    w = weights[order]
    errors = np.concatenate([[0.0], np.cumsum(np.where(toxic, w, 0))]) + np.concatenate([np.cumsum(np.where(toxic, 0, w)[::-1])[::-1], [0.0]])
    gaps = np.diff(np.concatenate([[x[0] - 2], x, [x[-1] + 2]]))
    best = np.flatnonzero((errors <= errors.min() + 1e-9) & (gaps > 0))
    k = best[np.argmax(gaps[best])]
    return float(np.concatenate([[x[0] - 2], x])[k] + gaps[k] / 2)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Scorer:
    """Train on four fifths of the sample and calibrate on the rest, weighing kinds as all labels have them."""
    sample, counts = labelled_sample(docs, labels, "toxic", {1: max_toxic, 0: max_clean}, ["text"])
    kind = sample["_label"].to_numpy(np.int64)
    if len(set(kind)) < 2:
        return Scorer(None)
    apart = np.array([zlib.crc32(str(i).encode()) // 5 % 5 == 0 for i in sample["doc_id"]])
    if len(set(kind[apart])) < 2 or len(set(kind[~apart])) < 2:
        apart = np.arange(len(kind)) < 0
    texts = sample["text"].tolist()
    network = train([t for t, a in zip(texts, apart) if not a], kind[~apart])
    check = apart if apart.any() else ~apart
    found = Scorer(network).logits([t for t, c in zip(texts, check) if c])
    own = kind[check]
    weights = np.where(own == 1, counts.get(1, 1) / max(1, (kind == 1).sum()), counts.get(0, 1) / max(1, (kind == 0).sum()))
    return Scorer(network, bound(found, own, weights))


def score(text: Column, scorer: Scorer) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series(np.concatenate([scorer.scores(texts[a:b]) for a, b in slices([len(t) for t in texts])]) if texts else np.zeros(0))

    return run(text)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scorer = fit(docs, labels)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), score(F.col("text"), scorer).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
