"""Joins that hold when one key owns a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with at least this many rows is looked up by broadcast. There can be no more than rows / HOT_ROWS such
# keys, about 100,000 for 1e11 rows, so the broadcast side stays at a few MB.
HOT_ROWS = 1_000_000
HOT_SPREAD = 4096
SMALL_ROWS = 10_000


def checked_broadcast(df: DataFrame, source: DataFrame | None = None, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side is left to the planner.

    ``source`` is counted in place of ``df`` if ``df`` is made from it and cannot have more than a few rows for each.
    """
    counted = df if source is None else source
    return F.broadcast(df) if counted.limit(max_rows + 1).count() <= max_rows else df


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    values: Sequence[str],
    n_rows: str,
    spread_by: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``values`` of ``table`` (one row per key) to ``rows``, with hot keys kept out of the shuffle key.

    ``n_rows`` is the column of ``table`` that counts the key's rows. Hot keys take their values from the broadcast
    side and get a random-like salt, so that no task receives a whole hot key; all other keys join by shuffle.
    ``how`` is "left" or "inner".
    """
    on = list(on)
    packed = F.struct(*values)
    is_hot = F.col(n_rows) >= hot_rows
    hot = table.where(is_hot).select(*on, packed.alias("_hot"))
    # -1 is a salt no row asks for. A constant salt would be folded away and be no part of the shuffle key.
    # The filter keeps every row; it holds both sides to the same aggregate, whose shuffle is then made only once.
    cold = table.where(F.col(n_rows) >= 0).select(
        *on, F.when(is_hot, F.lit(-1)).otherwise(F.lit(0)).alias("_salt"), packed.alias("_cold")
    )
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        (F.pmod(F.xxhash64(*spread_by), F.lit(HOT_SPREAD)) + 1).cast("int")
    )
    out = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).join(cold, [*on, "_salt"], "left")
    picked = F.coalesce("_hot", "_cold")
    if how == "inner":
        out = out.where(picked.isNotNull())
    kept = [c for c in rows.columns if c not in values]
    return out.select(*kept, *[picked[v].alias(v) for v in values])
