"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dumptables.llm.common import store, table
from dumptables.llm.langid import drop_unknown, learn_languages
from dumptables.llm.ngram_join import drop_near_duplicates
from dumptables.llm.packing import pack_documents
from dumptables.llm.suffix import drop_repeats
from dumptables.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by the labels that are not held out."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the rest of the documents teach; texts without letters go."""
    return drop_unknown(docs, learn_languages(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat earlier ones."""
    return drop_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: No stage can be said in SQL: they learn, tokenize, or pack in order; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder before the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
