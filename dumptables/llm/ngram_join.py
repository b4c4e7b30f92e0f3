"""Near-duplicate documents: an n-gram Jaccard self-join with Bayesian candidate pruning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .common import longs, map_batches, slices, sorted_groups, store, texts
from .components import connected_components
from .rows import NO_ID, ROW, numbered

N_WORDS = 5
THRESHOLD = 0.8
#: Candidates agree in one of BANDS bands of ROWS MinHash values: at similarity 0.8 all but 1e-7 do.
BANDS, ROWS = 40, 5
#: A pair is dropped once the probability that it reaches the threshold is below this.
TOLERANCE = 1e-6
#: MinHash values compared before each test.
STEP = 40
#: Documents compared with one another in a task.
BLOCK = 512
MEMORY = 150_000

_WORDS = re.compile(r"\w+")
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, np.uint64)


class Shingler:
    """Sets of word n-grams as sorted 64-bit hashes; the hashes of words are remembered.

    Words are found in the text as written and then put in lower case, as lower case can move their borders.
    """

    def __init__(self, n: int = N_WORDS):
        self.n, self.known = n, {}

    def _words(self, text: str) -> np.ndarray:
        out = []
        for part in slices(text):
            words = _WORDS.findall(part)
            found = list(map(self.known.get, words))
            if None in found:
                if len(self.known) > MEMORY:
                    self.known.clear()
                for at, got in enumerate(found):
                    if got is None:
                        word = words[at]
                        found[at] = self.known[word] = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "replace"))
            out.append(np.array(found, np.uint64))
        return np.concatenate(out)

    def shingles(self, text: str) -> np.ndarray:
        """All runs of n words; the words of a shorter text are one run; a text without words has none."""
        words = self._words(text)
        n = min(self.n, len(words))
        if not n:
            return words
        with np.errstate(over="ignore"):
            runs = np.zeros(len(words) - n + 1, np.uint64)
            for at in range(n):
                runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[at:at + len(runs)]
            runs ^= runs >> np.uint64(31)
            runs *= np.uint64(0xD6E8FEB86659FD93)
            runs ^= runs >> np.uint64(29)
        return np.unique(runs)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit value for each of the random functions: the smallest over the set."""
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(shingles), 1024):
            part = shingles[begin:begin + 1024, None]
            out = np.minimum(out, ((part * _FACTORS + _SHIFTS) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def node_of(shingles: np.ndarray) -> int:
    """The name of a set of shingles: a 64-bit hash of its members."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def bands_of(signature: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(signature.reshape(BANDS, ROWS))]


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``compared`` with which a pair may still reach the threshold.

    With an even prior, the similarity of a pair that agrees in m of n values has the Beta(m + 1, n - m + 1)
    distribution, which lies above t with the probability that n + 1 throws of chance t succeed at most m times.
    """
    below = 0.0
    for m in range(compared + 1):
        below += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if below >= tolerance:
            return m
    return compared


def surviving_pairs(left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that the incremental comparison does not drop."""
    total = left.shape[1]
    agree = np.zeros((len(left), len(right)), np.uint16)
    for c in range(min(STEP, total)):
        agree += left[:, c, None] == right[None, :, c]
    fine = agree >= least_matches(min(STEP, total), threshold, tolerance)
    if same:
        fine = np.triu(fine, 1)
    a, b = np.nonzero(fine)
    count = agree[a, b].astype(np.int64)
    for begin in range(STEP, total, STEP):
        if not len(a):
            break
        end = min(begin + STEP, total)
        more = np.concatenate([
            (left[a[at:at + 65536], begin:end] == right[b[at:at + 65536], begin:end]).sum(1) for at in range(0, len(a), 65536)])
        count = count + more
        keep = count >= least_matches(end, threshold, tolerance)
        a, b, count = a[keep], b[keep], count[keep]
    return a, b


def exact_jaccard(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the chosen pairs of sets."""
    if len(a) <= 200:
        both = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], float)
    else:
        # Only shingles on both sides count; they are laid out in columns, some thousands at a time.
        rows, columns = np.unique(a), np.unique(b)
        every_left, every_right = np.concatenate([left[i] for i in rows]), np.concatenate([right[j] for j in columns])
        shared = np.intersect1d(every_left, every_right)
        row_of = np.repeat(np.arange(len(rows)), [len(left[i]) for i in rows])
        column_of = np.repeat(np.arange(len(columns)), [len(right[j]) for j in columns])
        at_left, at_right = np.searchsorted(shared, every_left), np.searchsorted(shared, every_right)
        in_left = shared[np.minimum(at_left, len(shared) - 1)] == every_left if len(shared) else np.zeros(len(every_left), bool)
        in_right = shared[np.minimum(at_right, len(shared) - 1)] == every_right if len(shared) else np.zeros(len(every_right), bool)
        sums = np.zeros((len(rows), len(columns)), np.float32)
        for begin in range(0, len(shared), 4096):
            x, y = np.zeros((len(rows), 4096), np.float32), np.zeros((len(columns), 4096), np.float32)
            pick = in_left & (at_left >= begin) & (at_left < begin + 4096)
            x[row_of[pick], at_left[pick] - begin] = 1
            pick = in_right & (at_right >= begin) & (at_right < begin + 4096)
            y[column_of[pick], at_right[pick] - begin] = 1
            sums += x @ y.T
        both = sums[np.searchsorted(rows, a), np.searchsorted(columns, b)].astype(float)
    sizes_left, sizes_right = np.array([len(s) for s in left], float), np.array([len(s) for s in right], float)
    return both / (sizes_left[a] + sizes_right[b] - both)


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float):
    """(pair, left nodes, right nodes, a, b): linked pairs of each block pair of the sorted stream."""
    for group in sorted_groups(batches, "pair"):
        nodes = group.column("node").to_numpy()
        fresh = np.r_[True, nodes[1:] != nodes[:-1]]  # a repeated row repeats its node
        if not fresh.all():
            group = group.filter(pa.array(fresh))
            nodes = nodes[fresh]
        block = group.column("block").to_numpy()
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(nodes), -1)
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        weights = group.column("weight").to_numpy()
        other = np.flatnonzero(block != block[0])
        same = not len(other)
        cut = len(nodes) if same else other[0]
        low, high = slice(0, cut), slice(0, cut) if same else slice(cut, len(nodes))
        a, b = surviving_pairs(signatures[low], signatures[high], same, threshold, tolerance)
        if len(a):
            near = exact_jaccard(sets[low], sets[high], a, b) >= threshold - 1e-12
            a, b = a[near], b[near]
        if len(a):
            yield nodes[low], nodes[high], weights[low], weights[high], a, b


def _stars(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by the links of one task."""
    places = {n: i for i, n in enumerate(nodes.tolist())}
    label = np.arange(len(nodes))
    x = np.fromiter((places[n] for n in a.tolist()), np.int64, len(a))
    y = np.fromiter((places[n] for n in b.tolist()), np.int64, len(b))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return nodes[label]
        label = new


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, node, bands): one row for each document; node is null where there are no words."""

    def work(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler(n)
        for batch in batches:
            node, bands = [], []
            for text in texts(batch):
                found = shingler.shingles(text)
                node.append(node_of(found) if len(found) else None)
                bands.append(bands_of(minhash(found)) if len(found) else [])
            yield {"doc_id": longs(batch, "id"), "node": node, "bands": bands}

    return map_batches(_narrow(docs, id_col, text_col), work, "doc_id bigint, node bigint, bands array<bigint>")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))


def _candidate_blocks(signed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """((node, block), (pair, block, block) as rows (pair, block)): every two nodes of a bucket meet in some pair.

    A bucket is a band's value that several nodes have. A node's home is the smallest of its buckets' smallest nodes,
    so most nodes of a group of near copies share a home; homes are cut into blocks. A block is compared with itself,
    and with each block it shares a bucket with.
    """
    postings = signed.where(F.col("node").isNotNull()).select("node", F.explode("bands").alias("bucket")).distinct()
    buckets = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where(F.col("n") > 1)
    members = store(postings.join(buckets.select("bucket", "hub"), "bucket"), "members")
    home = members.groupBy("node").agg(F.min("hub").alias("home"))
    sizes = home.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))
    blocks = store(lookup(home, sizes, ["home"], ["n"], "n", ["node"], "inner").select(
        "node", F.xxhash64("home", cut).alias("block")), "blocks")
    seen = members.join(blocks, "node").select("bucket", "block").distinct()
    wide = seen.groupBy("bucket").agg(F.min("block").alias("x"), F.max("block").alias("y")).where(F.col("x") != F.col("y"))
    shared = store(seen.join(wide.select("bucket"), "bucket"), "shared")
    across = shared.alias("l").join(shared.alias("r"), "bucket").where(F.col("l.block") < F.col("r.block")).select(
        F.col("l.block").alias("x"), F.col("r.block").alias("y")).distinct()
    pair = F.xxhash64("x", "y").alias("pair")
    own = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        F.xxhash64("block", "block").alias("pair"), "block")
    return blocks, own.union(across.select(pair, F.explode(F.array("x", "y")).alias("block")))


def _payload(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(node, weight, signature, shingles) of the wanted (node, doc_id, weight)."""
    rows = _narrow(docs, id_col, text_col).join(wanted.withColumnRenamed("doc_id", "id"), "id")

    def work(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler(n)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("node", "weight", "signature", "shingles")}
            size = 0
            for text, node, weight in zip(texts(batch), longs(batch, "node"), longs(batch, "weight")):
                found = shingler.shingles(text)
                if not len(found) or node_of(found) != node:  # another row with the id
                    continue
                for name, value in (("node", node), ("weight", weight), ("signature", minhash(found).tobytes()),
                                    ("shingles", found.tobytes())):
                    out[name].append(value)
                size += found.nbytes
                if size > 1 << 23:
                    yield out
                    out, size = {c: [] for c in out}, 0
            yield out

    return map_batches(rows, work, "node bigint, weight bigint, signature binary, shingles binary")


def _blocks_to_compare(docs: DataFrame, n_words: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their nodes, nodes with their documents, rows of block pairs in order)."""
    signed = store(_signed(docs, id_col, text_col, n_words), "signed")
    nodes = store(signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("copy_id")), "nodes")
    blocks, pairs = _candidate_blocks(signed, block)
    wanted = blocks.select("node").join(nodes, "node").select("node", F.col("copy_id").alias("doc_id"), "weight")
    payload = _payload(docs, wanted, id_col, text_col, n_words)
    met = pairs.join(blocks, "block").select("pair", "block", "node").join(payload, "node")
    return signed, nodes, met.repartition("pair").sortWithinPartitions("pair", "block", "node")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n_words: int = N_WORDS,
                    block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_id, n_links) for each row: near-duplicate classes by word n-grams.

    Two documents are linked if the Jaccard similarity of their sets of ``n_words``-word runs (lower case, letters,
    digits and underscores) is at least ``threshold``. ``class_id`` is the smallest id that links lead to, ``copy_id``
    the smallest id with an equal set, ``n_links`` the number of documents linked to this one, copies included. Texts
    without words are linked to none; a text of fewer words is one run. Rows that repeat an id are documents of
    their own that share its class. A null id counts as the smallest id, and comes back as null.

    Documents of equal sets are one node from the start, so a group of copies costs one row. Nodes that agree in a
    MinHash band are candidates. They are compared in blocks: MinHash values ``STEP`` at a time, dropping a pair as
    soon as the posterior probability that it reaches the threshold falls below ``tolerance``; what survives is
    verified on the whole sets. A task returns the number of links of each node and one edge for each node, never the
    pairs, so that a group of thousands of near copies stays small; large groups are split into pairs of blocks.
    """
    signed, nodes, ordered = _blocks_to_compare(docs, n_words, block, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]):
        for left, right, weight_left, weight_right, a, b in _compare(batches, threshold, tolerance):
            every = np.unique(np.concatenate([left[a], right[b]]))
            links = np.zeros(len(every), np.int64)
            np.add.at(links, np.searchsorted(every, left[a]), weight_right[b])
            np.add.at(links, np.searchsorted(every, right[b]), weight_left[a])
            yield {"node": every, "links": links, "root": _stars(every, left[a], right[b])}

    linked = store(map_batches(ordered, work, "node bigint, links bigint, root bigint"), "links")
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(totals, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("n_nodes"))
    named = lookup(named, classes, ["root"], ["class_id"], "n_nodes", ["node"], "inner")
    facts = named.select("node", "weight", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = lookup(signed.select("doc_id", "node"), facts, ["node"], ["copy_id", "class_id", "n_links"], "weight", ["doc_id"])
    shown = lambda c: F.nullif(F.coalesce(c, "doc_id"), F.lit(NO_ID)).alias(c)
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), shown("class_id"), shown("copy_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n_words: int = N_WORDS,
                  block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(copy_a, copy_b): the linked pairs of different sets themselves, by the smallest id of each set.

    For tables where their number is known to be small: a group of n near copies has up to n * n / 2.
    """
    _, nodes, ordered = _blocks_to_compare(docs, n_words, block, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]):
        for left, right, _, _, a, b in _compare(batches, threshold, tolerance):
            yield {"a": left[a], "b": right[b]}

    found = map_batches(ordered, work, "a bigint, b bigint")
    ids = nodes.select("node", "copy_id")
    out = found.join(ids.select(F.col("node").alias("a"), F.col("copy_id").alias("x")), "a").join(
        ids.select(F.col("node").alias("b"), F.col("copy_id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("copy_a"), F.greatest("x", "y").alias("copy_b"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class of ``near_duplicates`` with all its columns: the one with the smallest id.

    A null id counts as the smallest id here, too. Rows that share an id, or have none, are documents of their own, each
    judged by its own text; of those in one class one stays, told by a number of the row. Rows without words stay, but
    rows that repeat both id and text are one document.
    """
    rows = numbered(docs, id_col, text_col)
    at = id_col if rows is None else ROW
    found = near_duplicates(docs if rows is None else rows, id_col=at, text_col=text_col, **options).select("doc_id", "class_id")
    known = lambda c: F.coalesce(c, F.lit(NO_ID))
    gone = found.where(known("doc_id") != known("class_id")).select(F.col("doc_id").alias("__gone"))
    if rows is not None:
        named = rows.where(F.col(id_col).isNotNull()).select(
            ROW, F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__key"))
        firsts = named.groupBy("__id", "__key").agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
        again = named.join(firsts, ["__id", "__key"]).where(F.col(ROW) > F.col("__first"))
        gone = gone.union(again.select(ROW)).distinct()
    docs, columns = docs if rows is None else rows, docs.columns
    return docs.join(store(gone, "gone"), docs[at].cast("bigint") == F.col("__gone"), "left_anti").select(*columns)
