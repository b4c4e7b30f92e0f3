"""Spelling variants: words one edit apart, each sent to its far more frequent form, by dense prefix-suffix tiling.

Two words are one insertion, deletion or replacement apart exactly when their common prefix and common suffix
together reach the longer length minus one (and they differ). Near words of lengths L and L + 1 (or both L) share
either the first half or the second half of the shorter one, so words meet in blocks keyed by (side, L, half);
a block is cut into tiles of at most ``TILE`` words, and each pair of tiles is compared as padded code-point
matrices in numpy. Only near pairs leave a task; no pair of words is ever a row before it is found near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sorted_groups, store

# Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
CUT = 199
MIN_CHARS = 6
MIN_COUNT = 5
FORM_RATIO = 5

#: Words of a block that one task compares with the words of another tile at most.
TILE = 512
#: Booleans a comparison holds at once (rows x columns x code points).
CELLS = 1 << 24
#: Rounds of following forms; each multiplies n by at least FORM_RATIO, so 40 rounds cover any count below 5**40.
MAX_ROUNDS = 40


def variant_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and their counts: results of at least MIN_CHARS code points that occur at least MIN_COUNT times.

    Runs of letters are lower-cased (A-Z only); a run whose crc32 of ``<id>:<run>`` is divisible by CUT loses its
    code point h % length. A null text has no runs; a null id gives no crc32 and so no cut.
    """
    runs = docs.select(F.col(id_col).cast("bigint").alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), 0)).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("lw"))
    h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("lw")).cast("binary"))
    cut = lowered.withColumns({"h": h}).select(
        F.when(F.col("h") % CUT == 0, F.expr("substring(lw, 1, cast(h % char_length(lw) as int)) || substring(lw, cast(h % char_length(lw) as int) + 2)"))
        .otherwise(F.col("lw")).alias("word"))
    counted = cut.where(F.char_length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def _keys(word: Column) -> Column:
    """The blocks of a word: (side, L, half) as the shorter word of length L, and as the longer one of length L + 1."""
    length = F.char_length(word)
    long_l = length - 1
    as_short = [F.struct(F.lit("p").alias("side"), length.alias("l"), F.expr("substring(word, 1, cast(floor(char_length(word) / 2) as int))").alias("half")),
                F.struct(F.lit("s").alias("side"), length.alias("l"), F.expr("substring(word, cast(floor(char_length(word) / 2) as int) + 1)").alias("half"))]
    as_long = [F.struct(F.lit("p").alias("side"), long_l.alias("l"), F.expr("substring(word, 1, cast(floor((char_length(word) - 1) / 2) as int))").alias("half")),
               F.struct(F.lit("s").alias("side"), long_l.alias("l"),
                        F.expr("substring(word, cast(floor((char_length(word) - 1) / 2) as int) + 2)").alias("half"))]
    return F.when(long_l >= MIN_CHARS, F.array(*as_short, *as_long)).otherwise(F.array(*as_short))


def _codes(words: list[str], pad: int, right: bool) -> np.ndarray:
    width = max(map(len, words))
    out = np.full((len(words), width), pad, dtype=np.int32)
    for row, word in enumerate(words):
        codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.int32)
        if right:
            out[row, width - len(codes):] = codes
        else:
            out[row, :len(codes)] = codes
    return out


def near_in_tiles(left: list[str], right: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs (a, b) of ``left`` x ``right`` that are exactly one edit apart, by common prefix plus common suffix."""
    if not left or not right:
        return
    lengths_r = np.array([len(w) for w in right])
    pre_r, suf_r = _codes(right, -2, False), _codes(right, -2, True)
    width = max(pre_r.shape[1], max(map(len, left)))
    pre_r = np.pad(pre_r, ((0, 0), (0, width - pre_r.shape[1])), constant_values=-2)
    suf_r = np.pad(suf_r, ((0, 0), (width - suf_r.shape[1], 0)), constant_values=-2)
    step = max(1, CELLS // max(1, len(right) * width))
    for begin in range(0, len(left), step):
        part = left[begin:begin + step]
        lengths_l = np.array([len(w) for w in part])
        pre_l, suf_l = _codes(part, -1, False), _codes(part, -1, True)
        pre_l = np.pad(pre_l, ((0, 0), (0, width - pre_l.shape[1])), constant_values=-1)
        suf_l = np.pad(suf_l, ((0, 0), (width - suf_l.shape[1], 0)), constant_values=-1)
        lcp = np.cumprod(pre_l[:, None, :] == pre_r[None, :, :], axis=2).sum(axis=2)
        lcs = np.cumprod((suf_l[:, None, :] == suf_r[None, :, :])[:, :, ::-1], axis=2).sum(axis=2)
        longer = np.maximum(lengths_l[:, None], lengths_r[None, :])
        near = (np.abs(lengths_l[:, None] - lengths_r[None, :]) <= 1) & (lcp + lcs >= longer - 1) & (lcp < longer)
        for i, j in zip(*np.nonzero(near)):
            yield part[i], right[j]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for group in sorted_groups(batches, "block"):
        words = group.column("word").to_pylist()
        tiles = group.column("tile").to_pylist()
        first, last = group.column("ti")[0].as_py(), group.column("tj")[0].as_py()
        left = [w for w, t in zip(words, tiles) if t == first]
        right = left if first == last else [w for w, t in zip(words, tiles) if t == last]
        pairs = list(near_in_tiles(left, right))
        if pairs:
            yield {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}


def near_pairs(words: DataFrame) -> DataFrame:
    """Every ordered pair (a, b) of distinct ``words.word`` one edit apart, each once."""
    keyed = words.select("word", F.explode(_keys(F.col("word"))).alias("k")).select("word", "k.*")
    sizes = keyed.groupBy("side", "l", "half").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("size") / TILE)).cast("int")
    placed = (keyed.join(sizes, ["side", "l", "half"])
              .withColumn("tile", F.pmod(F.xxhash64("word"), tiles).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
              .withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")})
              .withColumn("block", F.concat_ws("\x00", "side", "l", "ti", "tj", "half")))
    grouped = placed.repartition("block").sortWithinPartitions("block").select("block", "word", "tile", "ti", "tj")
    found = map_batches(grouped, _compare, "a string, b string")
    return found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*").distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see :func:`variant_words`).

    ``form``: the near word of largest n (ties: smallest in code-point order) if that n is at least FORM_RATIO
    times the word's, else null; ``root``: forms followed to the last, the word itself if it has none. Empty or
    all-null tables give no rows; extra columns are not read.
    """
    words = store(variant_words(docs, id_col, text_col), "spelling-words")
    edges = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = edges.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near"))).alias("top"))
    vocab = (words.join(best, "word", "left")
             .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                     F.when(-F.col("top.neg") >= FORM_RATIO * F.col("n"), F.col("top.near")).alias("form"),
                     F.when(-F.col("top.neg") >= FORM_RATIO * F.col("n"), -F.col("top.neg")).cast("bigint").alias("form_n")))
    vocab = store(vocab, "spelling-forms")
    forms = vocab.where(F.col("form").isNotNull()).select(F.col("word").alias("at"), F.col("form").alias("next"))
    rooted = vocab.withColumn("root", F.coalesce("form", "word"))
    for _ in range(MAX_ROUNDS):
        step = rooted.join(forms, rooted["root"] == forms["at"], "left")
        if step.where(F.col("next").isNotNull()).isEmpty():
            break
        rooted = store(step.withColumn("root", F.coalesce("next", "root")).drop("at", "next"), "spelling-roots")
    else:
        raise RuntimeError("forms did not end within MAX_ROUNDS rounds")
    return rooted.select("word", "form", "root", "n", "n_near", "form_n")
