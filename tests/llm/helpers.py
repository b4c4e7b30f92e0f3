"""Rows that every operator must stand: nulls, empty and long texts, repeats, and columns with clashing names."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, score string, bucket int, node string"


def documents(spark, rows):
    """A documents table of (doc_id, text) or (doc_id, text, lang), with extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), 7, "x", None, "n") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_rows():
    return [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "word"), (5, "word"), (None, "no id here"), (6, "漢字 😀 a\u0301 ▁ <|endoftext|>"),
            (7, "x" * 30_000), (8, "many words " * 3_000), (9, "!!! ... ???")]
