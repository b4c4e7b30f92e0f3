"""Articles and the category corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY_OPEN, extract_categories
from .ids import dense_index

ARTICLES_PER_FILE = 10_000


def article_lookup(page: DataFrame, revision: DataFrame, text: DataFrame) -> DataFrame:
    """Page id → latest revision → its text. Every join key is unique on at least one narrow side."""
    ids = page.select("page_id", "page_latest").join(
        revision.select(F.col("rev_id").alias("page_latest"), "rev_text_id"), "page_latest"
    )
    texts = text.select(F.col("old_id").alias("rev_text_id"), F.col("old_text").alias("article"))
    return ids.join(texts, "rev_text_id").select(
        "page_id", F.col("page_latest").alias("rev_id"), F.col("rev_text_id").alias("text_id"), "article"
    )


def article_record(articles: DataFrame, text: str = "article") -> DataFrame:
    """(page_id, article, categories)."""
    return articles.select("page_id", F.col(text).alias("article"), extract_categories(text).alias("categories"))


def corpus_rows(pages: DataFrame) -> DataFrame:
    """(category, ordinal, article): one row for each distinct category of a page.

    The ordinal counts all pages in document order, from 0. Only page keys are sorted; text is joined by page id, and
    only for pages that can have a category. A plain search picks those: a filter on the categories themselves would
    be pushed down and extract them twice.
    """
    ordinals = dense_index(pages, ["page_id"], ["page_seq"], "ordinal")
    tagged = pages.where(F.contains("text", F.lit(CATEGORY_OPEN))).select(
        "page_id", F.col("text").alias("article"), F.array_distinct(extract_categories("text")).alias("categories")
    )
    # An inner explode would have the same effect: it filters its input for arrays that are not empty.
    rows = tagged.join(ordinals, "page_id").select(
        F.explode_outer("categories").alias("category"), "ordinal", "article"
    )
    return rows.where(F.col("category").isNotNull())


def category_counts(pages: DataFrame) -> DataFrame:
    """Documents per category; neither ordinals nor texts leave the scan."""
    names = pages.select(F.explode(F.array_distinct(extract_categories("text"))).alias("category"))
    return names.groupBy("category").agg(F.count(F.lit(1)).alias("n_pages"))


def write_corpus(rows: DataFrame, path: str, articles_per_file: int = ARTICLES_PER_FILE, mode: str = "error") -> None:
    """One folder per category. A large category is cut in files by ordinal, so it is written by many tasks."""
    piece = F.floor(F.col("ordinal") / articles_per_file)
    rows.repartition("category", piece).write.mode(mode).partitionBy("category").parquet(path)
