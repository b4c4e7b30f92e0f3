"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters of a k-gram, and k-grams of a window: a common passage of K + WINDOW - 1 characters is always met.
K = 12
WINDOW = 48
#: Windows that a short text has at least, as far as it has k-grams.
LEAST = 64
#: Characters hashed at once.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit rolling hashes of all runs of ``k`` code points, built from runs of powers of two."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run, base = (points.astype(np.uint64) + np.uint64(1)) * _MIX, _BASE
        out, done, width = None, 0, 1
        while True:
            if k & width:
                if out is None:
                    out = run[:n].copy()
                else:
                    out = out * base + run[done:done + n]
                done += width
            if 2 * width > k:
                break
            run = run[:-width] * base + run[width:]
            base, width = base * base, 2 * width
        out ^= out >> np.uint64(32)
        out *= _MIX
        return out ^ (out >> np.uint64(29))


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Smallest value of every window, by doubling."""
    out, width = values, 1
    while 2 * width <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < window:
        out = np.minimum(out[:len(out) - (window - width)], out[window - width:])
    return out


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprint: the smallest k-gram of each window, the rightmost of equal ones.

    Two texts with a common passage of k + window - 1 characters share an entry, at the same place of the passage,
    if both are at least 2k long. Texts with few k-grams use smaller windows, at least ``LEAST`` of them: what a large
    window chooses, every smaller one chooses too, so this only adds entries. Texts shorter than 2k, which are below
    the guarantee, use grams of a quarter of their length. The empty text has no entry.
    """
    points = _code_points(text)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(points) < 2 * k:
        k = max(1, min(k, len(points) // 4))
    window = max(1, min(window, (len(points) - k + 1) // LEAST))
    places, found = [], []
    begin, total = 0, len(points) - k + 1
    while True:
        grams = gram_hashes(points[begin:begin + CHUNK + k - 1], k)
        # The place counts down in the low half, so the rightmost of equal hashes is the smallest.
        down = np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | down
        chosen = np.unique(np.uint64(0xFFFFFFFF) - (window_minima(keys, window) & np.uint64(0xFFFFFFFF)))
        at = chosen.astype(np.int64)
        places.append(at + begin)
        found.append(grams[at])
        if begin + len(grams) >= total:
            break
        begin += len(grams) - (window - 1)  # windows over the border of two parts belong to the next part
    if len(places) == 1:
        return places[0], found[0]
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(found)[first]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints as sets of hashes; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(places: np.ndarray, hashes: np.ndarray) -> str:
    """``hash@place`` of every entry, hashes as 8 hexadecimal digits of their upper half."""
    top = (hashes >> np.uint64(32)).tolist()
    return ",".join([f"{h:08x}@{p}" for h, p in zip(top, places.tolist())])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, places, hashes) for each row; null and empty texts have empty lists. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            marks = [winnow(t or "", k, window) for t in batch.column("text").to_pylist()]
            yield {"id": batch.column("id"), "places": [p.tolist() for p, _ in marks],
                   "hashes": [h.view(np.int64).tolist() for _, h in marks]}

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, work, "id bigint, places array<bigint>, hashes array<bigint>")


def edited(text: str, follower: str) -> str:
    """The last quarter of the code points replaced by as many (or all) from the start of the next document."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + follower[:quarter]


def with_next(docs: DataFrame, work, schema: str, buckets: int | None = None) -> DataFrame:
    """Run ``work(rows)`` on consecutive documents in order of (doc_id, text); ``rows`` yields (doc_id, text, next text).

    The last document is followed by the first. Ids are cut into ranges by approximate quantiles, one task each, and
    the first document of each range is sent to the range before as well, so texts are shuffled once. A null id comes
    first. Only the quantiles and the smallest id of each range come to the driver.
    """
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                         F.col("doc_id").isNull().alias("no_id"))
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = narrow.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [n / buckets for n in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    bounds = sorted({int(c) for c in cuts})

    def placed_by(values: list[int], results: list[int] | None, side: str):
        """A column function: the place of an id among ``values``, or the result that goes with an equal one."""
        known, given = np.array(values, np.int64), None if results is None else np.array(results, np.int64)

        @F.pandas_udf("bigint")
        def place(ids: pd.Series) -> pd.Series:
            x = ids.to_numpy()
            at = np.searchsorted(known, x, side=side)
            if given is None:
                return pd.Series(at)
            hit = np.minimum(at, len(known) - 1)
            return pd.Series(np.where(known[hit] == x, given[hit], -1))

        return place

    placed = narrow.withColumn("bucket", placed_by(bounds, None, "right")("doc_id"))
    firsts = placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()  # one row a range
    order = [r["bucket"] for r in firsts]
    # A range holds all rows of its smallest id, so of repeated ids all are sent, and the first in order is used.
    lender = placed_by([r["first"] for r in firsts] or [0], [order[n - 1] for n in range(len(order))] or [-1], "left")
    # A number for each range whose hash leads to a partition of its own, so that no two ranges meet in a task.
    spare = spark.range(40 * max(1, len(order))).select("id", F.pmod(F.hash("id"), F.lit(max(1, len(order)))).alias("part"))
    slots = {r["part"]: r["id"] for r in spare.groupBy("part").agg(F.min("id").alias("id")).collect()}
    slot_of = placed_by(order or [0], [slots.get(n, n) for n in range(len(order))] or [0], "left")
    here = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("lent"))
    there = F.struct(F.col("lender").alias("at"), F.lit(1).alias("lent"))
    rows = placed.withColumn("lender", lender("doc_id")).withColumn(
        "copy", F.explode(F.when(F.col("lender") >= 0, F.array(here, there)).otherwise(F.array(here)))
    ).select("copy.at", "copy.lent", "doc_id", "text", "no_id")

    def run(batches: Iterator[pa.RecordBatch]):
        def consecutive():
            held = None
            for batch in batches:
                for at, lent, doc_id, text, no_id in zip(*(batch.column(c).to_pylist() for c in ("at", "lent", "doc_id", "text", "no_id"))):
                    if held is not None and held[0] == at and not held[1]:
                        yield None if held[4] else held[2], held[3], text
                    # Of the documents lent to a range, only the first follows its last one.
                    held = (at, lent, doc_id, text, no_id)

        return work(consecutive())

    ordered = rows.withColumn("slot", slot_of("at")).repartition(max(1, len(order)), "slot").drop("slot")
    return map_batches(ordered.sortWithinPartitions("at", "lent", "doc_id", "text"), run, schema)


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how like they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): the edited text has
    its last quarter replaced by the start of the next document; ``near_next`` compares with the next document
    itself. Null texts are empty. One row for each row given, repeated ids included.
    """

    def work(rows):
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                "near_edited", "near_next")}
        size, last = 0, None
        for doc_id, text, follower in rows:
            # The follower of the row before is this row.
            own = last if last is not None and last[0] is text else (text, winnow(text, k, window))
            last = (follower, winnow(follower, k, window))
            changed = edited(text, follower)
            mark = own[1] if changed == text else winnow(changed, k, window)
            for name, value in (
                ("doc_id", doc_id), ("n_chars", len(text)),
                ("edited_sha256", hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()),
                ("fingerprint", digest(*own[1])), ("edited_fingerprint", digest(*mark)),
                ("near_edited", likeness(own[1][1], mark[1])), ("near_next", likeness(own[1][1], last[1][1])),
            ):
                out[name].append(value)
            size += len(out["fingerprint"][-1]) + len(out["edited_fingerprint"][-1])
            if size > 1 << 23 or len(out["doc_id"]) >= 4096:
                yield out
                out, size = {c: [] for c in out}, 0
        yield out

    return with_next(docs, work, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")


def guarantee(k: int = K, window: int = WINDOW) -> int:
    """Length from which a common passage is always met."""
    return k + window - 1


__all__ = ["edited", "edited_likeness", "fingerprint", "gram_hashes", "guarantee", "likeness", "window_minima", "winnow", "with_next"]
