"""Importance resampling towards a target: hashed n-gram counts by DuckDB in each partition, merged and scored by Spark.

Each partition's texts go through DuckDB in blocks of bounded size: SQL takes the words, unnests them, builds runs of
neighbouring words by window functions and groups them by the bucket of a registered zlib CRC. The counts of each document's
buckets are spilled to Parquet in the shared folder. Spark merges them into counts over all documents, gives each bucket the
log ratio of its share in the target texts to its share in all documents, sums a document's ratios and adds Gumbel noise
from a hash of its id; the highest scores are a sample without replacement in proportion to the importance.

Defined results: a null or empty text has no features and a weight of 0; a null id is hashed as an empty one; repeated rows
each count and are each drawn for themselves; equal scores go to the smaller id, nulls last; without target texts the
target's shares rest on smoothing alone; an empty table gives no rows; a long text is a block of its own, and other columns
aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, placed, slices, stored

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents with fewer words aren't drawn; the share of the others that is.
MIN_WORDS, PERCENT = 20, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of text that DuckDB handles at a time.
BLOCK_CHARS = 1 << 21
COUNTED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def _crc(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in column.to_pylist()], pa.int64())


def counting_sql(longest: int, buckets: int) -> str:
    """SQL over a table texts (row, text): each row's number of words and of features, and its buckets with their counts."""
    after = lambda i: f"lead(word, {i}) over (partition by row order by place)"
    runs = [f"select row, {' || chr(32) || '.join(['word', *map(after, range(1, n))])} as gram from words" for n in range(1, longest + 1)]
    return rf"""
with found as (select row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as list from texts),
words as (select row, unnest(list) as word, generate_subscripts(list, 1) as place from found),
grams as (select row, gram from ({' union all '.join(runs)}) where gram is not null),
hashed as (select gram, (crc32(gram) % {buckets})::integer as bucket from (select distinct gram from grams)),
counted as (select row, bucket, count(*)::integer as n from grams join hashed using (gram) group by row, bucket),
lists as (select row, sum(n)::bigint as n_features, list(bucket order by bucket) as buckets, list(n order by bucket) as counts from counted group by row)
select row, len(list)::bigint as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(buckets, []) as buckets, coalesce(counts, []) as counts
from found left join lists using (row) order by row"""


def _counter(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    sql = counting_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            db.create_function("crc32", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for begin, end in slices(batch.column("chars").to_pylist(), BLOCK_CHARS):
                    part = batch.slice(begin, end - begin)
                    db.register("texts", pa.table({"row": pa.array(range(end - begin), pa.int64()), "text": part.column("text")}))
                    out = db.sql(sql).to_arrow_table()
                    db.unregister("texts")
                    yield from pa.table([part.column("doc_id"), *(out.column(f.name).cast(f.type) for f in list(schema)[1:])], schema=schema).to_batches()

    return run


def counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets and counts of every row of docs (doc_id, text), spilled to Parquet."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return stored(own.mapInArrow(_counter(longest, buckets), COUNTED), "bucket-counts")


def totals(counted: DataFrame) -> DataFrame:
    """bucket and n, its features over all rows."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("_x"))
    return each.groupBy(F.col("_x.buckets").alias("bucket")).agg(F.sum("_x.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with an array of every bucket's gain, from totals of all documents and of the target texts."""
    full = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = full.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("rows"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = lambda x: ((x["t"] + 1) * (F.col("all_s") + buckets)).cast("double") / ((x["s"] + 1) * (F.col("all_t") + buckets)).cast("double")
    return rows.select(F.transform("rows", lambda x: F.floor(F.lit(1000) * F.log(ratio(x)))).alias("gains"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of a hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def scores(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; target has texts in a column text."""
    counted = counts(docs, longest, buckets)
    wanted = counts(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    model = cut(gains(totals(counted), totals(wanted), buckets))
    own = counted.withColumn("_gains", model.select("gains").scalar())
    each = F.zip_with("buckets", "counts", lambda b, n: F.get("_gains", b) * n)
    weighed = own.select("doc_id", "n_words", "n_features", F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank is null for those that aren't drawn."""
    own = cut(scores(docs, target, longest, buckets, seed).withColumn("_tie", F.monotonically_increasing_id()))
    able = own.filter(F.col("n_words") >= min_words)
    most = able.count() * percent // 100
    ranks = placed(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")])
    drawn = ranks.filter(F.col("_row") < most).select("doc_id", "n_features", "weight", "score", (F.col("_row") + 1).alias("rank"))
    rest = ranks.filter(F.col("_row") >= most).unionByName(own.filter(F.col("n_words") < min_words), allowMissingColumns=True)
    return drawn.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
