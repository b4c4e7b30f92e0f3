"""License scans: fixed phrases found in place, and license templates found by an exact set-similarity join.

A text block is a window of as many consecutive words as the template has; it meets a template when it holds at least
``THRESHOLD`` of the template's distinct words (containment). Template words are ordered by how many documents of the
whole corpus hold them (rarest first, counted by Spark). A block that meets the threshold must hold one of the first
``s - ceil(THRESHOLD * s) + 1`` words of that order (prefix filter), so only places of those words open candidates; a
window is checked only from the first prefix word inside it (positional filter), and texts with fewer words than the
needed overlap are skipped (length filter). The check then counts the window exactly, so every block that meets the
threshold is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed values of the contract: the word pattern and the base phrases with their labels.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Templates of the method (label, words), written as the words the pattern gives.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8


def _needed(size: int) -> int:
    """Smallest overlap that reaches THRESHOLD of ``size`` words, exactly in integers."""
    share = Fraction(str(THRESHOLD))
    return -(-share.numerator * size // share.denominator)


#: The word pattern on UTF-8 bytes: every byte of a character beyond ASCII is above 0x7F, so the words are the same.
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of characters outside the ASCII signs; null is the empty text."""
    return WORD_BYTES.findall(text.translate(LOWER_BYTES)) if text else []


def base_places(words: list[bytes]) -> tuple[list[int], list[str]]:
    """Starts of all consecutive places of the base phrases (0-based), and the labels that have some."""
    starts, labels = [], []
    for phrase, label in BASE:
        parts = [w.encode() for w in phrase.split()]
        k, first = len(parts), parts[0]
        found = [i for i, w in enumerate(words) if w == first and words[i:i + k] == parts]
        starts += found
        if found:
            labels.append(label)
    return starts, sorted(labels)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _order(texts: DataFrame) -> dict[str, int]:
    """Rank of every template word by the number of documents that hold it (rarest first), over all rows.

    Each task counts the documents that hold each template word; Spark adds the counts up.
    """
    vocabulary = sorted({w for _, text in TEMPLATES for w in text.split()})
    wanted = {w.encode() for w in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(wanted.intersection(words_of(text)))
        yield {"w": [w.decode() for w in held], "n": list(held.values())}

    counts = dict(map_batches(texts.select("text"), count, "w string, n bigint").groupBy("w").agg(F.sum("n")).collect())
    return {w: rank for rank, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _plan(order: dict[str, int]) -> list[tuple[str, frozenset[str], int, int, frozenset[str]]]:
    """(label, distinct words, window width, needed overlap, prefix words) of every template."""
    plan = []
    for label, text in TEMPLATES:
        parts = text.split()
        distinct = sorted(set(parts), key=order.__getitem__)
        need = _needed(len(distinct))
        plan.append((label, frozenset(distinct), len(parts), need, frozenset(distinct[:len(distinct) - need + 1])))
    return plan


def find_blocks(words: list[str], plan) -> list[tuple[str, int, float]]:
    """(label, start, containment) of every window that meets its template, by prefix, positional and length filters."""
    found = []
    n = len(words)
    for label, distinct, width, need, prefix in plan:
        if n < need:
            continue
        last_start = max(0, n - width)
        anchors = [i for i, w in enumerate(words) if w in prefix]
        previous = -1
        for at in anchors:
            begin, end = max(previous + 1, at - width + 1, 0), min(at, last_start)
            previous = at
            if begin > end:
                continue
            held = Counter(w for w in words[begin:begin + width] if w in distinct)
            for start in range(begin, end + 1):
                if start > begin:
                    gone, come = words[start - 1], words[start + width - 1] if start + width - 1 < n else None
                    if gone in distinct:
                        held[gone] -= 1
                        if not held[gone]:
                            del held[gone]
                    if come is not None and come in distinct:
                        held[come] += 1
                if len(held) >= need:
                    found.append((label, start, len(held) / len(distinct)))
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks of every row.

    ``n_base`` counts all places of the base phrases; ``first_word``/``last_word`` are the smallest and largest of their
    starts (null without places); ``base_labels`` their labels, ``labels`` those and the labels of the templates that
    some block meets, distinct, sorted and comma-joined (empty if none). ``score`` is the largest containment of a
    block that meets its template (0 if none), ``n_blocks`` the number of such (template, window) pairs. A null text
    is the empty text: 0 words, no places, empty labels, score 0. Every row gives one row; repeated or null ids are
    rows of their own; extra columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    plan = [(label, frozenset(w.encode() for w in distinct), width, need, frozenset(w.encode() for w in prefix))
            for label, distinct, width, need, prefix in _plan(_order(texts))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks")}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                starts, base = base_places(words)
                blocks = find_blocks(words, plan)
                out["n_words"].append(len(words))
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(base))
                out["labels"].append(",".join(sorted(set(base) | {b[0] for b in blocks})))
                out["score"].append(max((b[2] for b in blocks), default=0.0))
                out["n_blocks"].append(len(blocks))
            yield {"doc_id": batch.column("doc_id"), **out}

    schema = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
              "labels string, score double, n_blocks bigint")
    return map_batches(texts, scan, schema)
