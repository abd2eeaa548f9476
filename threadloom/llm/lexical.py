"""Ranked lexical search over document shards: postings in CSR form with integer impacts, searched term at a time by numpy.

The index has one row a shard: the shard's document ids, its terms with the number of their postings, and the postings of all
terms one after another, as the documents' places in the shard and what the term adds there for each unit of weight. What a
document's length and a term's occurrences add is an integer of its own (impact), worked out once when the index is built from
two sums over all documents. How rare a term is, its weight, comes from the shards' counts, joined to the queries' terms alone.

A search reads the shards in a map. For each query it adds weight times impact along the postings of one term after another to
an array with a place for each document, and takes the highest by argpartition, with all that tie with the last of them before
ids decide. A task keeps the best of all its shards and emits them at its end, so that what Spark merges grows with tasks and
queries, not with documents. Queries are a stated set: they go to the tasks in blocks of about BLOCK_TERMS terms, one block at
a time; no row is left out.

Defined results: a null or empty text has no terms, doesn't count and is never found; a query without terms finds nothing;
repeated rows are each a document, or a query, for themselves; equal scores go to the smaller id, nulls last; empty tables give
no rows; a long text is a shard of its own; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Saturation of a term's occurrences, and percent of the length in it.
SATURATION, LENGTH = 12, 25
TOP = 20
#: Characters of a shard's texts, and pairs of query and term in a block.
SHARD_CHARS, BLOCK_TERMS = 1 << 22, 1 << 17
#: Parts that a query's best of all tasks are first merged in.
SALTS = 64
INDEX = "doc_ids array<long>, terms array<string>, counts array<int>, places binary, impacts binary"
FOUND = "query long, doc_id long, score long"


def terms_of(text: Column) -> Column:
    """The text's terms in order, with A to Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have, with repeats."""
    n = docs.select(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long").alias("n")).filter("n > 0")
    found = n.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return found["documents"], found["terms"]


def shard(ids: pa.Array, texts: list[str], documents: int, all_terms: int) -> dict:
    """The index row of some texts: postings sorted by term, then by place."""
    found = [re.findall(TERM, t) for t in texts]
    lengths = [len(x) for x in found]
    codes, seen = pd.factorize(np.array(list(chain.from_iterable(found)), dtype=object))
    low = str.maketrans(UPPER, LOWER)
    merged, terms = pd.factorize(np.array([t.translate(low) for t in seen], dtype=object))
    pairs = merged[codes].astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths) if len(terms) else np.zeros(0, np.int64)
    pairs, tf = np.unique(pairs, return_counts=True)
    term, place = np.divmod(pairs, len(texts))
    # Python's whole numbers: the product passes 64 bits on very large tables
    penalty = np.array([100 - LENGTH + LENGTH * n * documents // max(1, all_terms) for n in lengths], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + SATURATION * penalty[place])
    return {"doc_ids": ids, "terms": terms.tolist(), "counts": np.bincount(term, minlength=len(terms)).astype(np.int32), "places": place.astype(_places(len(texts))).tobytes(), "impacts": impact.astype(np.int32).tobytes()}


def _places(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _indexer(documents: int, all_terms: int, shard_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("impacts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("chars").to_pylist(), shard_chars):
                part = batch.slice(begin, end - begin)
                row = shard(part.column("doc_id"), part.column("text").to_pylist(), documents, all_terms)
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if f.name != "doc_ids" else pa.ListArray.from_arrays([0, end - begin], row["doc_ids"]) for f in schema], schema=schema)

    return run


def build(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, int]:
    """The index of docs (doc_id, text), stored as Parquet, and the number of documents with a term."""
    documents, all_terms = sizes(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return stored(own.mapInArrow(_indexer(documents, all_terms, shard_chars), INDEX), "postings"), documents


def weighed(index: DataFrame, documents: int, pairs: DataFrame) -> DataFrame:
    """pairs (query, term, repeats) with weight: how rare the term is, in thousandths, times its repeats. Terms in no document are left out."""
    wanted = cut(pairs.select("term").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BLOCK_TERMS else wanted.hint("shuffle_merge")
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("_x")).select(F.col("_x.terms").alias("term"), F.col("_x.counts").alias("n"))
    df = each.join(wanted, "term", "leftsemi").groupBy("term").agg(F.sum("n").alias("df"))
    rarity = F.floor(F.lit(1000) * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return pairs.join(df.hint("shuffle_merge"), "term").select("query", "term", (rarity * F.col("repeats")).alias("weight"))


def best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, top: int) -> np.ndarray:
    """Places of the top highest scores above 0, highest first; equal ones by id, nulls last."""
    if len(scores) > top:
        least = max(1, int(scores[np.argpartition(scores, len(scores) - top)[len(scores) - top]]))
        kept = np.flatnonzero(scores >= least)  # all that tie with the last
    else:
        kept = np.flatnonzero(scores > 0)
    return kept[np.lexsort((ids[kept], nulls[kept], -scores[kept]))[:top]]


def _searcher(vocabulary: list[str], queries: dict[int, tuple[np.ndarray, np.ndarray]], top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """queries: for each query places in the vocabulary, and weights."""
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary, pa.string())
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[r].values
                nulls, ids = doc_ids.is_null().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy()
                starts = np.concatenate([[0], np.cumsum(batch.column("counts")[r].values.to_numpy())])
                places = np.frombuffer(batch.column("places")[r].as_buffer(), _places(len(ids)))
                impacts = np.frombuffer(batch.column("impacts")[r].as_buffer(), np.int32)
                at = pc.index_in(terms, value_set=batch.column("terms")[r].values).fill_null(-1).to_numpy()
                total = np.zeros(len(ids), np.int64)
                for query, (of, weights) in queries.items():
                    total.fill(0)
                    for k, weight in zip(at[of].tolist(), weights.tolist()):
                        if k >= 0:
                            a, b = starts[k], starts[k + 1]
                            total[places[a:b]] += weight * impacts[a:b].astype(np.int64)
                    i = best(total, ids, nulls, top)
                    if len(i):
                        now = total[i], ids[i], nulls[i]
                        if query in kept:
                            now = tuple(np.concatenate(x) for x in zip(kept[query], now))
                            j = best(*now, top)
                            now = tuple(x[j] for x in now)
                        kept[query] = now
        for query, (scores, ids, nulls) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_chars: int = SHARD_CHARS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the highest-scoring documents of each row of items (item_id, text)."""
    index, documents = build(docs, shard_chars)
    queries = cut(items.select("item_id", terms_of(F.col("text")).alias("_terms")).withColumn("query", F.monotonically_increasing_id()))
    pairs = queries.select("query", F.explode("_terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("repeats"))
    own = cut(weighed(index, documents, pairs))
    blocks = max(1, math.ceil(own.count() / block_terms))
    found = None
    for block in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).orderBy("query", "term").toPandas()
        codes, vocabulary = pd.factorize(rows["term"])
        rows["code"] = codes
        asked = {int(q): (x["code"].to_numpy(), x["weight"].to_numpy(np.int64)) for q, x in rows.groupby("query")}
        part = index.select("doc_ids", "terms", "counts", "places", "impacts").mapInArrow(_searcher(list(vocabulary), asked, top), FOUND)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumns({"_part": F.spark_partition_id() % SALTS, "_tie": F.monotonically_increasing_id()})
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("query", "_part").orderBy(*order, "_tie"))).filter(F.col("_r") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order, "_tie"))).filter(F.col("rank") <= top)
    return ranked.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
