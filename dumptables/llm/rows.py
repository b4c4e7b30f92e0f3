"""Rows that their ids do not tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Stands for a null id, which counts as the smallest.
NO_ID = -(1 << 63)
ROW = "__row"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``docs`` with a number of each row in order of id, then of a hash of the text; None if no two rows share one.

    A null id counts as an id, the smallest one. The rows are stored in that order, so that the numbers belong to one evaluation.
    """
    ids = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"))
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
        return None
    order = {"__id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), "__key": F.xxhash64(F.col(text_col).cast("string")),
             "__at": F.monotonically_increasing_id()}
    rows = docs.withColumns(order).repartitionByRange(*order).sortWithinPartitions(*order)
    return store(rows.withColumn(ROW, F.monotonically_increasing_id()).drop(*order), "rows")
