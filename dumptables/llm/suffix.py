"""Repeated passages by a sparse suffix array over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .common import longs, map_batches, slices, store, texts
from .ngram_join import Shingler
from .rows import NO_ID, ROW, numbered
from .winnow import gram_hashes, window_minima

#: Words of a passage that counts as repeated.
LENGTH = 50
#: Suffixes are retained at the smallest K-word hash of each window of WINDOW starts.
K, WINDOW = 8, 32
#: Suffixes are ordered by digests of so many of their first words (after the LENGTH - WINDOW + 1 that must agree).
STEPS = (27, 35, 43, 50)

_WORDS = re.compile(r"\w+")


def least_shared(length: int, window: int) -> int:
    """Words that follow the retained suffix of a passage in any case."""
    return length - window + 1


class Suffixes:
    """Retained suffixes of texts: positions chosen by content, so that equal passages retain the same ones."""

    def __init__(self):
        self.shingler = Shingler()

    def words(self, text: str) -> np.ndarray:
        return self.shingler._words(text)

    @staticmethod
    def retained(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, place): the passages that start at first..last meet in the suffix at ``place``.

        The suffix of a passage is the smallest K-word hash of its first WINDOW starts, the rightmost of equal ones;
        it depends on the passage alone. Every start of a whole passage belongs to exactly one suffix.
        """
        starts = len(words) - LENGTH + 1
        if starts <= 0:
            return (np.zeros(0, np.int64),) * 3
        grams = gram_hashes(words, K)[:starts + WINDOW - 1]
        down = np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
        chosen = window_minima((grams & np.uint64(0xFFFFFFFF00000000)) | down, WINDOW)
        place = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return first, np.r_[first[1:], len(place)] - 1, place[first]

    @staticmethod
    def order_keys(words: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(head, ladder): the hash of the words that must agree, and 16-bit digests of ever longer beginnings.

        Ordered by both, suffixes that share a longer beginning lie closer together, as in any suffix order. Where
        the text ends before a step, the digest is one of the place, so that it agrees with no other.
        """
        head = gram_hashes(words, least_shared(LENGTH, WINDOW))[place]
        ladder = np.zeros(len(place), np.uint64)
        for step in STEPS:
            grams = gram_hashes(words, step)
            inside = place < len(grams)
            digest = place.astype(np.uint64) * np.uint64(40503) + np.uint64(len(words))
            digest[inside] = grams[place[inside]] >> np.uint64(48)
            ladder = (ladder << np.uint64(16)) | (digest & np.uint64(0xFFFF))
        return head, ladder


def _shared_words(head: np.ndarray, ladder: np.ndarray) -> np.ndarray:
    """The most words that each suffix can share with the one before it; 0 without a common head.

    Beginnings that agree at one step of the ladder and differ at the next share fewer words than the next has.
    """
    most = [step - 1 for step in STEPS[1:]] + [LENGTH]
    shared = np.where(head[1:] == head[:-1], STEPS[0] - 1, 0)
    differ = ladder[1:].view(np.uint64) ^ ladder[:-1].view(np.uint64)
    for n in range(len(STEPS)):
        # A step counts if it and all before it agree.
        shared = np.where((shared > 0) & ((differ >> np.uint64(16 * (len(STEPS) - 1 - n))) == 0), most[n], shared)
    return np.r_[0, shared]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))


def _described(docs: DataFrame) -> DataFrame:
    """(id, whole, n_words, and the retained suffixes as packed columns) of each document."""

    def work(batches: Iterator[pa.RecordBatch]):
        suffixes = Suffixes()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "whole", "n_words", "first", "last", "place", "head", "ladder")}
            for doc_id, text in zip(longs(batch, "id"), texts(batch)):
                words = suffixes.words(text)
                first, last, place = suffixes.retained(words)
                head, ladder = suffixes.order_keys(words, place) if len(place) else (np.zeros(0, np.uint64),) * 2
                for name, value in (
                    ("id", doc_id), ("whole", xxhash.xxh64_intdigest(words.tobytes()) - (1 << 63)), ("n_words", len(words)),
                    ("first", first.tolist()), ("last", last.tolist()), ("place", place.tolist()),
                    ("head", head.view(np.int64).tolist()), ("ladder", ladder.view(np.int64).tolist()),
                ):
                    out[name].append(value)
            yield out

    return map_batches(docs, work, "id bigint, whole bigint, n_words int, first array<int>, last array<int>, place array<int>, "
                                   "head array<bigint>, ladder array<bigint>")


def _candidates(suffixes: DataFrame) -> DataFrame:
    """(id, first, last): starts of passages that may occur again, by comparing neighbours in suffix order.

    The most words that a suffix shares with any other it shares with a neighbour, so a passage that needs more
    words to the right of its suffix occurs once. Suffixes at the border of a sorted part, whose neighbour is in
    another task, stay in.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        names = ("id", "first", "last", "place", "head", "ladder")
        held, before = None, LENGTH  # the first row of a part has an unknown neighbour

        def reach(c, most):
            last = np.minimum(c["last"], c["place"] + most - LENGTH)
            keep = (most > 0) & (last >= c["first"])
            return {"id": c["id"][keep], "first": c["first"][keep], "last": last[keep]}

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy() for n in names}
            if held is not None:
                c = {n: np.r_[held[n], c[n]] for n in names}
            shared = _shared_words(c["head"], c["ladder"])
            shared[0] = before
            yield reach({n: c[n][:-1] for n in names}, np.maximum(shared[:-1], shared[1:]))
            held, before = {n: c[n][-1:] for n in names}, int(shared[-1])
        if held is not None:
            yield reach(held, np.array([LENGTH]))

    ordered = suffixes.repartitionByRange("head", "ladder", "id", "place").sortWithinPartitions("head", "ladder", "id", "place")
    return map_batches(ordered, work, "id bigint, first int, last int")


def _passages(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(gram, id, places): every passage of LENGTH words that starts in a range, once for each document."""
    listed = ranges.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def work(batches: Iterator[pa.RecordBatch]):
        suffixes = Suffixes()
        for batch in batches:
            for doc_id, text, spans in zip(longs(batch, "id"), texts(batch), batch.column("ranges").to_pylist()):
                grams = gram_hashes(suffixes.words(text), LENGTH)
                wanted = np.zeros(len(grams) + 1, np.int64)
                for span in spans:
                    wanted[min(span["first"], len(grams))] += 1
                    wanted[min(span["last"] + 1, len(grams))] -= 1
                at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
                if not len(at):
                    continue
                chosen = grams[at].view(np.int64)
                unique, index, count = np.unique(chosen, return_index=True, return_counts=True)
                places = [[p] for p in at[index].tolist()]
                if (count > 1).any():
                    for n in np.flatnonzero(count > 1).tolist():
                        places[n] = at[chosen == unique[n]].tolist()
                for begin in range(0, len(unique), 50_000):
                    end = begin + 50_000
                    yield {"gram": unique[begin:end], "id": [doc_id] * len(unique[begin:end]), "places": places[begin:end]}

    return map_batches(docs.join(listed, "id"), work, "gram bigint, id bigint, places array<int>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, cut, first_id): passages of ``LENGTH`` words or more that occur more than once.

    Words are lower-case runs of letters, digits and underscores; what lies between them does not count. A row is a
    maximal run of words all of whose ``LENGTH``-word passages occur elsewhere, in this text or another. ``cut`` tells
    that it repeats what came before (in order of id, then of place); the first occurrence has it false. A run is
    divided where ``cut`` or ``first_id``, the smallest document of the passage, changes; parts of divided runs overlap
    by the words of one passage less one. Texts below ``LENGTH`` words have no rows, null and empty texts neither.
    Ids are expected to be unique: rows of one id share their places. A null id counts as the smallest, and is null.

    Method: suffixes are retained at minimizer positions, about 6 in 100. Documents of equal words are one document
    at first. Suffixes are sorted by a ladder of digests and compared with their neighbours, which tells how far any
    match reaches to the right; what cannot reach ``LENGTH`` words goes. The rest is extended to the left as whole
    passages, matched by their hashes, since the longest match to the left need not be a neighbour. No group is ever
    gathered: the sort splits groups of equal suffixes, and passages meet in aggregates.
    """
    narrow = _narrow(docs, id_col, text_col)
    described = store(_described(narrow), "suffixes")
    groups = described.where(F.col("n_words") >= LENGTH).groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    twins = store(lookup(described.where(F.col("n_words") >= LENGTH).select("id", "whole", "n_words"), groups.where(F.col("n") > 1),
                         ["whole"], ["first_id"], "n", ["id"], "inner"), "twins")
    later = twins.where(F.col("id") != F.col("first_id"))
    single = described.join(store(later.select("id", "whole"), "later"), ["id", "whole"], "left_anti")
    suffixes = store(single.select("id", F.explode(F.arrays_zip("first", "last", "place", "head", "ladder")).alias("s")).select("id", "s.*"), "sparse")
    ranges = store(_candidates(suffixes), "ranges")
    passages = store(_passages(narrow, ranges), "passages")
    firsts = passages.groupBy("gram").agg(F.sum(F.size("places")).alias("n"), F.min("id").alias("first_id"))
    again = lookup(passages, firsts.where(F.col("n") > 1), ["gram"], ["first_id"], "n", ["id"], "inner")
    marks = again.groupBy("id").agg(F.collect_list(F.struct("places", "first_id")).alias("marks"))

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "start_word", "n_words", "cut", "first_id")}
            for doc_id, found in zip(longs(batch, "id"), batch.column("marks").to_pylist()):
                # In the first document the earliest place is the first occurrence; all others repeat it.
                every = sorted((p, n > 0 or m["first_id"] != doc_id, m["first_id"]) for m in found for n, p in enumerate(m["places"]))
                begin = 0
                for n in range(1, len(every) + 1):
                    if n == len(every) or every[n][0] != every[n - 1][0] + 1 or every[n][1:] != every[n - 1][1:]:
                        for name, value in (("id", doc_id), ("start_word", every[begin][0]), ("n_words", n - begin + LENGTH - 1),
                                            ("cut", every[begin][1]), ("first_id", every[begin][2])):
                            out[name].append(value)
                        begin = n
            yield out

    spans = map_batches(marks, work, "id bigint, start_word int, n_words int, cut boolean, first_id bigint")
    # Documents of equal words: the first one keeps its text, all others repeat it from end to end.
    copies = twins.select("id", F.lit(0).alias("start_word"), "n_words", (F.col("id") != F.col("first_id")).alias("cut"), "first_id")
    shown = lambda c, to: F.nullif(F.col(c), F.lit(NO_ID)).alias(to)
    return spans.unionByName(copies).select(shown("id", "doc_id"), "start_word", "n_words", "cut", shown("first_id", "first_id"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the (first, end) spans and what lies between them, joined by a line break."""
    ends: list[tuple[int, int]] = []
    base = 0
    for part in slices(text):
        ends.extend((m.start() + base, m.end() + base) for m in _WORDS.finditer(part))
        base += len(part)
    kept, at = [], 0
    for first, end in spans:
        end = min(end, len(ends))
        if first >= end:
            continue
        kept.append(text[at:ends[first][0]])
        at = ends[end - 1][1]
    kept.append(text[at:])
    return "\n".join(k for k in (x.strip() for x in kept) if k)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with passages cut that repeat earlier ones; the first occurrence of each passage stays.

    All columns stay, and ``n_chars``, where there is one, counts what is left. A document of which nothing is left
    keeps its row with an empty text. Rows without an id come first; rows that share an
    id, or have none, are told apart by a number of the row, and each loses only what it repeats itself.
    """
    rows = numbered(docs, id_col, text_col)
    at = id_col if rows is None else ROW
    rows = docs if rows is None else rows
    spans = repeated_passages(rows, at, text_col).where("cut").groupBy("doc_id").agg(
        F.collect_list(F.struct("start_word", "n_words")).alias("__spans")).select(F.col("doc_id").alias("__id"), "__spans")

    @F.udf("string", useArrow=True)
    def cut(text, spans):
        if spans is None:
            return text
        merged: list[list[int]] = []
        for first, n in sorted((s["start_word"], s["n_words"]) for s in spans):
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], first + n)
            else:
                merged.append([first, first + n])
        return cut_words(text or "", [tuple(m) for m in merged])

    known = lambda c: F.coalesce(c, F.lit(NO_ID))
    joined = rows.join(spans, known(rows[at].cast("bigint")) == known(F.col("__id")), "left")
    text = cut(rows[text_col].cast("string"), "__spans")
    joined = joined.withColumn("__text", text)
    count = F.when(F.col("__spans").isNotNull(), F.length("__text")).otherwise(rows["n_chars"]) if "n_chars" in docs.columns else None
    new = {text_col: F.col("__text"), "n_chars": count}
    return joined.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else rows[c] for c in docs.columns])
