"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A bin is filled greedily, each time with the longest piece that fits. If a gap stays, the bin's shortest piece gives way to
the two unpacked pieces that fit the widened gap most tightly. Only lengths matter for this, and there are no more lengths
than the capacity: the plan is made from one count for each length, over all documents, as patterns of lengths with the
number of bins that are filled so. Spark then deals the pieces to the plan's places by their rank among those of equal length.

Ranks come from the tasks that tokenize: each numbers its own pieces of a length, and one row for each task and length says
what precedes it. Their table is cut to the shared checkpoint folder first, so that ranks stay as they were when a task is
run again. Full pieces fill a sequence alone and need no rank. No group of pieces meets in one task.

Defined results: a null text is empty, and a document without ids is its end mark alone; repeated rows are packed each for
itself; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Chunks of text whose ids a task keeps; it starts afresh beyond.
MAX_CHUNKS = 400_000

#: Runs of white space that a split at single blanks would tear.
TORN = re.compile(r"\s | \s|<\|")


#: Letters and marks after them.
ENDED = re.compile(r"([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]+)")


class ChunkTokenizer:
    """A byte-level tokenizer that encodes each distinct chunk between single blanks once.

    Its pattern joins a blank to the word after it, so a single blank between two other characters always begins a token's
    piece of text, and the chunks are encoded alike apart and together. Texts with wider space or special tokens go whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        # the same vocabulary as ranks, which is several times as fast for single words
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.word = self._ranked(ranks) if os.path.exists(ranks) else None

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, texts: list[str]) -> list[bytes]:
        if self.word is None:
            return self._ask(texts)
        word, code = self.word, self.code
        return [array(code, word(t)).tobytes() for t in texts]

    def _learn(self, fresh: set[str]) -> None:
        """Ids of the chunks after a blank. A word and the marks after it are apart for the pattern, so the word is asked for alone."""
        later = self.later
        ended = {c: m.groups() for c in fresh if (m := ENDED.fullmatch(c))}
        words = [w for w in (fresh - ended.keys()) | {w for w, _ in ended.values()} if w not in later]
        later.update(zip(words, self._ask_words([" " + w for w in words])))
        marks = list({m for _, m in ended.values()})
        ids = dict(zip(marks, self._ask(marks)))
        later.update((c, later[w] + ids[m]) for c, (w, m) in ended.items())

    def forget(self) -> None:
        """Drop the chunks that are kept."""
        self.first.clear()
        self.later.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.first) + len(self.later) > MAX_CHUNKS:
            self.forget()
        whole = [i for i, t in enumerate(texts) if TORN.search(t)]
        done = dict(zip(whole, self._ask([texts[i] for i in whole]))) if whole else {}
        rows = [[] if i in done else t.split(" ") for i, t in enumerate(texts)]
        first, later = self.first, self.later
        if fresh := list({r[0] for r in rows if r and r[0] not in first}):
            first.update(zip(fresh, self._ask(fresh)))
        if fresh := {c for r in rows for c in r[1:] if c not in later}:
            self._learn(fresh)
        return [np.frombuffer(done[i] if i in done else first[r[0]] + b"".join([later[c] for c in r[1:]]), dtype=self.code) for i, r in enumerate(rows)]


_loaded: dict[str, ChunkTokenizer] = {}


def _tokenizer(name: str) -> ChunkTokenizer:
    if name not in _loaded:
        _loaded[name] = ChunkTokenizer(tokenizer_path(name))
    return _loaded[name]


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) for each piece: all but the first are as long as the capacity."""
    data, n = ids.astype("<u4").tobytes(), len(ids)
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    return [(k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, with the number of their task and their rank among its pieces of that length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, task, seen = _tokenizer(name), TaskContext.get().partitionId(), [0] * (capacity + 1)
        try:
            for batch in batches:
                texts, keys, rows = ["" if t is None else t for t in batch["text"]], batch["doc_id"].tolist(), []
                for a, b in slices([len(t) for t in texts]):
                    for key, ids in zip(keys[a:b], tokenizer.encode(texts[a:b])):
                        for piece, start, length, crc in pieces_of(np.append(ids.astype("<u4"), np.uint32(end_id)), capacity):
                            rows.append((key, piece, start, length, crc, task, seen[length]))
                            seen[length] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
                out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
                yield out
        finally:
            # a worker goes on to other stages, whose memory the chunks would take
            tokenizer.forget()

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (number of bins, pieces of each length in such a bin), from the number of pieces of each length.

    A pattern is used as often as the pieces last for, so each one uses up a length, or nearly so; there are some thousands
    of patterns at most, however many pieces there are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    out: list[tuple[int, dict[int, int]]] = []
    while left.any():
        free, uses, gap = left.copy(), {}, capacity
        while gap and len(fits := np.flatnonzero(free[: gap + 1])):
            length = int(fits[-1])
            n = int(min(free[length], gap // length))
            uses[length] = uses.get(length, 0) + n
            free[length] -= n
            gap -= n * length
        shortest = min(uses)
        if gap:
            room = gap + shortest
            # for each length the longest free one up to it, and for two of one kind there must be two
            upto = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            one = np.flatnonzero(free[: room + 1])
            other = upto[room - one]
            other = np.where((other == one) & (free[one] < 2), upto[np.maximum(one - 1, 0)], other)
            pair = np.where(other > 0, one + other, 0)
            if len(pair) and pair.max() > shortest:
                best = int(np.flatnonzero(pair == pair.max())[-1])
                uses[shortest] -= 1
                for length in (int(one[best]), int(other[best])):
                    uses[length] = uses.get(length, 0) + 1
        uses = {length: n for length, n in uses.items() if n}
        times = min(int(left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= n * times
        out.append((times, uses))
    return out


class Places:
    """Where the piece of a length and rank goes, by a plan."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for times, uses in patterns:
            offset = 0
            for length, n in sorted(uses.items(), reverse=True):
                rows.setdefault(length, []).append((taken.get(length, 0), first, n, offset))
                taken[length] = taken.get(length, 0) + n * times
                offset += n * length
            first += times
        self.rows = {length: np.array(r, dtype=np.int64).T for length, r in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each piece."""
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            begin, first, n, at = self.rows[int(length)]
            k = np.searchsorted(begin, ranks[own], side="right") - 1
            inside = ranks[own] - begin[k]
            sequence[own] = first[k] + inside // n[k]
            offset[own] = at[k] + inside % n[k] * length
        return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    pieces = cut(tokenized(docs, capacity, name, end_id))
    counts = pieces.filter(F.col("length") < capacity).groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    # one row for each length, of which there are fewer than the capacity
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(totals, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(*own, (-1 - (F.col("task").cast("long") * F.lit(1 << 36) + F.col("rank"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).join(counts, ["task", "length"]).withColumn("_p", place("length", F.col("before") + F.col("rank")))
    return rest.select(*own, "_p.sequence_id", "_p.offset").unionByName(full)
