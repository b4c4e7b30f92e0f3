"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import longs, map_batches, slices, store, texts

MAX_TOKENS = 2048
#: Words whose ids a task remembers; a full memory is emptied.
MEMORY = 300_000
#: A document's placement is looked up by length and rank in one number: ranks stay below 2**48.
RANK_BITS = 48


class ByteTokenizer:
    """Ids of the byte-level BPE vocabulary as ``tokenizers`` gives them, as little-endian 32-bit bytes.

    A token never crosses a space between two characters that are no white space, so such parts are encoded once and
    remembered. Parts of Latin letters go through the faster ``tiktoken`` with the same merges; parts that may hold a
    special token or other scripts go through ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.spaced = np.zeros(max(ranks.values()) + 1, bool)
            self.spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}

    @classmethod
    def public(cls) -> ByteTokenizer:
        import public_tokenizers as files

        return cls(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)

    def _plain(self, part: str) -> bool:
        """Latin letters only and no special token, where both libraries are known to agree."""
        return self.fast is not None and "<|" not in part and max(part, default="") < "ɐ"

    def _part(self, part: str) -> bytes:
        if self._plain(part):
            ids = self.fast.encode_ordinary(part)
        else:
            ids = self.slow.encode(part, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self._slice(part) for part in slices(text))

    def _slice(self, text: str) -> bytes:
        if not text:
            return b""
        first, *parts = text.split(" ")
        if not first and parts:  # a slice that begins with a space
            first = " " + parts.pop(0)
        if len(self.known) > MEMORY:
            self.known.clear()
        found = list(map(self.known.get, parts))
        if None in found:
            new = list(dict.fromkeys(part for part, ids in zip(parts, found) if ids is None))
            if any(not part or part[0].isspace() or part[-1].isspace() for part in new):
                return self._rough(first, parts)
            self._learn(new)
            found = list(map(self.known.__getitem__, parts))
        if first.startswith("  ") or not first.strip() or first[-1].isspace():
            return self._rough(first, parts)
        return self._part(first) + b"".join(found)

    def _learn(self, new: list[str]) -> None:
        """Encode new parts in one call: each begins with the only token that starts with a space."""
        joined = " " + " ".join(new)
        if self._plain(joined):
            ids = np.array(self.fast.encode_ordinary(joined), "<u4")
            starts = np.flatnonzero(self.spaced[ids]).tolist()
            if len(starts) == len(new):
                whole = ids.tobytes()
                for part, begin, end in zip(new, starts, [*starts[1:], len(ids)]):
                    self.known[part] = whole[4 * begin:4 * end]
                return
        for part in new:
            self.known[part] = self._part(" " + part)

    def _rough(self, first: str, parts: list[str]) -> bytes:
        """Parts with white space at an edge are joined with their neighbours before they are encoded."""
        out, held, loose = [], first, not first.strip() or first[-1].isspace()
        for part in parts:
            if not part or part[0].isspace() or loose:
                held += " " + part
            else:
                out.append(self._part(held))
                held = " " + part
            loose = not part or part[-1].isspace()
        out.append(self._part(held))
        return b"".join(out)


def tokenized_pieces(docs: DataFrame, tokenizer=ByteTokenizer.public, max_tokens: int = MAX_TOKENS,
                     id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): documents as token counts, cut where too long.

    ``end_id`` closes each document; a null text is empty and gives that one id. Pieces hold ``max_tokens`` ids, and
    the first one the rest. ``rank`` counts the pieces of one length inside the task ``part``. Texts don't leave the
    scan.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]):
        encoder = tokenizer()
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")}
            for doc_id, text in zip(longs(batch, "id"), texts(batch)):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                start, length = 0, (total - 1) % max_tokens + 1
                piece = 0
                while start < total:
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start), ("length", length),
                                        ("ids_crc32", zlib.crc32(ids[4 * start:4 * (start + length)])), ("part", part),
                                        ("rank", int(seen[length]))):
                        rows[name].append(value)
                    seen[length] += 1
                    start, length, piece = start + length, max_tokens, piece + 1
            yield rows

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


class OpenBins:
    """Remaining capacities that have open bins, as a segment tree: the smallest one that is large enough in O(log n)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def add(self, left: int, first: int, count: int) -> None:
        self.bins[left].append((first, count))
        self._mark(left)

    def _mark(self, left: int) -> None:
        node = left + self.size
        self.any[node] = bool(self.bins[left])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        node = length + self.size
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None

    def take(self, left: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` bins with ``left`` places."""
        first, count = self.bins[left].popleft()
        if count > most:
            self.bins[left].appendleft((first + most, count - most))
            count = most
        self._mark(left)
        return first, count


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over all documents, as runs: (length, first rank, first bin, offset, documents a bin).

    Documents of one length are alike, and so are open bins with one remaining capacity, so both are moved in runs. A
    bin that just took a document is the tightest for the next of that length, so it is filled before another one is
    begun. The plan equals placing the documents one by one, longest first, each in the tightest open bin. Its size
    depends on the capacity, not on the number of documents.
    """
    bins, next_bin, plan = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = bins.tightest(length)
            room = capacity if left is None else left
            each = min(room // length, todo)
            count = todo // each
            if left is None:
                first, next_bin = next_bin, next_bin + count
            else:
                first, count = bins.take(left, count)
            plan.append((length, rank, first, capacity - room, each))
            rank, todo = rank + count * each, todo - count * each
            if room > each * length:
                bins.add(room - each * length, first, count)
    return plan


def pack_best_fit(pieces: DataFrame, capacity: int = MAX_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: all pieces packed by best fit decreasing into sequences of ``capacity``.

    Only the number of pieces of each length comes to the driver, ``capacity`` numbers at most. There a segment tree
    over remaining capacities finds the tightest open sequence; the resulting runs, whose number is bounded by the
    capacity, are sent back, and each piece finds its place by its rank among the pieces of its length. The ranks
    come from counts for each task and length, so that no task holds all pieces of a common length.

    ``pieces`` comes from ``tokenized_pieces``; it is stored, as ranks belong to one evaluation. An empty table gives
    an empty table.
    """
    spark = pieces.sparkSession
    fixed = store(pieces, "pieces")
    counts = fixed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(totals, capacity)
    runs = np.array(sorted(((length << RANK_BITS) + rank, *rest) for length, rank, *rest in plan), np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast(runs)
    columns = [c for c in fixed.columns if c not in ("part", "rank")]

    def place(batches: Iterator[pa.RecordBatch]):
        starts, first, offset, each = (np.ascontiguousarray(c) for c in sent.value.T)
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            at = np.searchsorted(starts, (length << RANK_BITS) + rank, side="right") - 1
            inside = rank - (starts[at] & ((1 << RANK_BITS) - 1))
            out = {c: batch.column(c) for c in columns}
            out["sequence_id"] = first[at] + inside // each[at]
            out["offset"] = offset[at] + inside % each[at] * length
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fixed.schema if f.name in columns)
    return map_batches(fixed.join(offsets, ["part", "length"]), place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer=ByteTokenizer.public) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there."""
    return pack_best_fit(tokenized_pieces(docs, tokenizer, max_tokens), max_tokens)
