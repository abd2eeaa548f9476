"""The subpackage's queries, by name, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, gif, jaccard, lexical, mixing, packing, pii, quality, resample, rules, toxicity, urls
from .common import table
from .oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded text, for every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a GIF and read back."""
    return gif.store_documents(table(spark, sf_dir, "documents"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether rules and log-likelihood ratio keep it."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(table(spark, sf_dir, "conversations").select(added.columns).unionByName(added))


def op3_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.judge(table(spark, sf_dir, "documents"))


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and its number of links."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, beside its source's target."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, towards the benchmark's texts."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_pii_boosting": op1_pii_boosting,
    "op2_bpe_trie": op2_bpe_trie,
    "op3_toxicity_gru": op3_toxicity_gru,
    "op4_quality_cotraining": op4_quality_cotraining,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_url_markov": op6_url_markov,
    "op7_gif_media": op7_gif_media,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_mixing_tree": op11_mixing_tree,
    "op12_lexical_search": op12_lexical_search,
    "op13_importance_resampling": op13_importance_resampling,
}
