"""Dump files as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import normalize_title
from ..operators.revisions import current_of_page
from ..operators.tables import build_page_current, build_recentchanges, build_revision_current, build_text_current
from ..schema import CORRUPT, HEADER_XML, PAGE_XML
from ..sources.dump import PAGE_CLOSE, is_malformed, parse_pages

TABLE_BUILDERS = {
    "page": build_page_current,
    "revision": build_revision_current,
    "text": build_text_current,
    "recentchanges": build_recentchanges,
}


def stream_pages(
    spark: SparkSession, path: str, max_files_per_trigger: int = 8, schema: str = PAGE_XML
) -> DataFrame:
    """Parsed pages of the dump files that arrive in ``path``; the file count bounds a batch."""
    records = (
        spark.readStream.option("lineSep", PAGE_CLOSE).option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    )
    placed = records.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return parse_pages(placed, schema=schema)


def stream_titles(spark: SparkSession, path: str, max_files_per_trigger: int = 8) -> DataFrame:
    """(page_id, page_seq, full_title) of well-formed pages, numbered in document order.

    A stream has no row numbers, so tasks count the rows they read; only these narrow columns pass through Python.
    """
    pages = stream_pages(spark, path, max_files_per_trigger, HEADER_XML)
    narrow = good_pages(pages).select("file", "block", F.col("id").alias("page_id"),
                                      normalize_title("title").alias("full_title"))

    def count_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for frame in frames:
            yield frame.assign(row=range(done, done + len(frame)))
            done += len(frame)

    numbered = narrow.mapInPandas(
        count_rows, "file STRING, block BIGINT, page_id BIGINT, full_title STRING, row BIGINT"
    )
    return numbered.select("page_id", F.struct("file", "block", "row").alias("page_seq"), "full_title")


def stream_ingest(
    pages: DataFrame, path: str, checkpoint: str, user: str = "importer", **trigger
) -> StreamingQuery:
    """Write the four tables of the current-revision path, batch by batch.

    Each batch has its own folder and overwrites it, so a batch that is run again after a failure is not written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # parsed once for four tables
        try:
            for name, build in TABLE_BUILDERS.items():
                rows = build(batch, user) if name in ("revision", "recentchanges") else build(batch)
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        current_of_page(pages).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_dedup_titles(pages: DataFrame) -> DataFrame:
    """The first page with a title in document order, over the whole run. Use with output mode "update".

    A title is sent when it is met first, and again when a batch brings it anew; the row of the latest batch holds the
    page that comes first in document order among all so far, whatever the order in which files arrive. So a sink that
    replaces rows by title ends with the answer of :func:`~dumptables.operators.titles.dedup_titles`, and no clock is
    read. Partial aggregation keeps a frequent title from meeting in one task. State grows with the number of distinct
    titles, as the rule demands; use the RocksDB state store for large runs.
    """
    rest = [c for c in pages.columns if c != "full_title"]
    titles = pages.groupBy("full_title").agg(F.min_by(F.struct(*rest), "page_seq").alias("_first"))
    return titles.select(*[F.col("full_title") if c == "full_title" else F.col(f"_first.{c}") for c in pages.columns])


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.where(~is_malformed()).drop(CORRUPT)
