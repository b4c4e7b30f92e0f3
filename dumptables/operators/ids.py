"""Dense numbering in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .joins import HOT_ROWS, lookup

ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """``keys`` with their 0-based position in ``order``.

    Range-partition and sort the narrow keys, write them with their place in the partition, and add the number of
    rows in the partitions before. The keys are written out first, because the range bounds come from a sample and
    may differ from one evaluation to the next. The broadcast side has one row per shuffle partition.
    """
    placed = (
        df.select(*dict.fromkeys([*keys, *order]))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *keys,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)).alias("_row"),
        )
    )
    fixed = materialize(placed, "index")
    sizes = fixed.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition, not per key
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return fixed.join(F.broadcast(offsets), "_part").select(*keys, (F.col("_offset") + F.col("_row")).alias(name))


def renumber(headers: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ids from 1 in document order: (page_id, new_page_id, n_revisions) and (rev_id, new_rev_id)."""
    pages = dense_index(headers, ["page_id", "n_revisions"], ["page_seq"]).select(
        "page_id", (F.col("idx") + 1).alias("new_page_id"), "n_revisions"
    )
    revisions = dense_index(facts, ["rev_id"], ["page_seq", "rev_seq"]).select(
        "rev_id", (F.col("idx") + 1).alias("new_rev_id")
    )
    return pages, revisions


def remap_ids(facts: DataFrame, pages: DataFrame, revisions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Put new ids in place of ``page_id``, ``rev_id`` and ``parent_id`` (0 where the parent is not in the data)."""
    out = facts.join(revisions, "rev_id")
    out = lookup(out, pages, ["page_id"], ["new_page_id"], "n_revisions", ["rev_id"], "inner", hot_rows)
    parents = revisions.select(F.col("rev_id").alias("_parent"), F.col("new_rev_id").alias("_new_parent"))
    # First revisions have no parent; a key of their own keeps them from meeting in one task.
    out = out.withColumn("_parent", F.coalesce("parent_id", -F.col("rev_id"))).join(parents, "_parent", "left")
    new = {
        "page_id": F.col("new_page_id"),
        "rev_id": F.col("new_rev_id"),
        "parent_id": F.coalesce("_new_parent", F.lit(0)).cast("bigint"),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in facts.columns])


def remap_text_ids(text: DataFrame, revisions: DataFrame) -> DataFrame:
    """Text rows are keyed by the first revision that holds the text."""
    return text.join(revisions, text["old_id"] == revisions["rev_id"]).select(
        F.col("new_rev_id").alias("old_id"), *[c for c in text.columns if c != "old_id"]
    )


def remap_headers(headers: DataFrame, pages: DataFrame) -> DataFrame:
    return headers.join(pages.select("page_id", "new_page_id"), "page_id").select(
        *[F.col("new_page_id").alias("page_id") if c == "page_id" else F.col(c) for c in headers.columns]
    )


def order_main_ids(pages: DataFrame) -> DataFrame:
    """Ids of main-namespace pages in ascending order, with their rank from 0."""
    main = pages.where(F.col("page_namespace") == 0)
    return dense_index(main, ["page_id"], ["page_id"], "rank")


def batch_ids(pages: DataFrame, batch_size: int = 1000) -> DataFrame:
    """Main-namespace ids with their rank (from 0) and batch number; the last batch may be short."""
    main = pages.where(F.col("page_namespace") == 0)
    ranked = dense_index(main, ["page_id"], ["page_id"], "rank")
    return ranked.withColumn("batch", F.floor(F.col("rank") / batch_size).cast("bigint"))
