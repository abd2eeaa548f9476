"""A corpus pipeline: toxicity, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir). What it returns is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. Python workers get Arrow batches of few rows, unless the session sets their number. Labels for the two classifiers are those of the data folder's labels table.

Defined results: rows with a null or empty text are judged as empty texts; extra columns are kept, whatever their names;
empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import jaccard, packing, pii, quality, toxicity
from threadloom.llm.common import shared_folder, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    small_batches(spark)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs["text"], scorer) < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(docs, model) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is that of the new text."""
    small_batches(spark)
    finder = pii.fit(docs)
    new = docs.withColumn("text", pii.redacted(docs["text"], finder))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]
#: Trained models decide; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; their tables lie in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
