"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at a time; a longer single text is a slice of its own.
SLICE_CHARS = 1 << 20
#: Rows that Spark hands a Python worker at a time, where the session doesn't say how many.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a data folder; Spark's reader opens it, wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's spark.checkpoint.dir. Only where that is unset in a local session, as in tests, a temporary one is set; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have BATCH_ROWS rows at most, unless the session says how many. A batch of Spark's 10,000 whole texts lies in each task as rows, as Arrow and as strings at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no earlier stage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read again from there, so that later steps read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df, written out, with _row, its rows' places from 0 in the given order, and for each name the sum of a column over all rows before.

    Rows are dealt by ranges of the order. Each range numbers its own; one row for each range says what precedes it, so that no
    range holds more than its share as long as the order tells rows apart.
    """
    parted = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    whole = {"_row": F.lit(1).cast("long"), **sums}
    ranges = parted.groupBy("_part").agg(*(F.sum(c).alias(f"_all_{name}") for name, c in whole.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ranges = ranges.select("_part", *(F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_all_{name}") for name in whole))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {name: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_all_{name}") for name, c in whole.items()}
    found = parted.join(F.broadcast(ranges), "_part")
    return found.select(*(c for c in df.columns), *(c.alias(name) for name, c in before.items()))


def slices(lengths, limit: int = SLICE_CHARS):
    """Consecutive (begin, end) ranges whose lengths sum to at most limit, or that hold one item."""
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies: in the folder that THREADLOOM_TOKENIZERS names, else in the installed package."""
    folder = os.environ.get("THREADLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def hash_share(key, wanted: int, of: int):
    """Whether a key is in a share of hashes that holds about as many of the given number; a cheap first cut before a top-k by hash."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(min(1 << 30, (wanted << 30) // max(1, of) + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], columns: list[str], held_fold: bool = True):
    """At most most[c] labelled documents of each class c, in the order of a hash, as a pandas frame, and the classes' full counts.

    Rows whose crc32(doc_id as text) mod 5 is 0 are left out if held_fold is set. A document with several labels has the
    greatest; one with several rows gives the least text. Only the sampled ids are sent to the tasks.
    """
    own = labels.filter(F.col(label).isin(list(most)) & F.col("doc_id").isNotNull())
    if held_fold:
        own = own.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    own = own.groupBy("doc_id").agg(F.max(label).alias("_label"))
    counts = {r["_label"]: r["n"] for r in own.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    ids = None
    for c, n in most.items():
        part = own.filter((F.col("_label") == c) & hash_share(F.col("doc_id"), 3 * n, counts.get(c, 0))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id")
    rest = [c for c in columns if c != "text"]
    one = found.groupBy("doc_id", "_label").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), *rest)).alias("_row"))
    return one.select("doc_id", "_label", "_row.*").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas(), counts
