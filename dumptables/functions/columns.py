"""Scalar rules of the dump as column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of the data format.
CATEGORY_PATTERN = r"\[\[Category:([a-zA-Z0-9_\s\-]+)\]\]"
REDIRECT_WORD = "#REDIRECT"
LINK_OPEN = "[["
CATEGORY_OPEN = "[[Category:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_title(title: Column | str) -> Column:
    """Spaces become underscores."""
    return F.translate(_col(title), " ", "_")


def timestamp_digits(ts: Column | str) -> Column:
    """``2005-08-31T01:02:03Z`` → ``20050831010203``; null → ''."""
    return F.coalesce(F.regexp_replace(_col(ts), "[^0-9]", ""), F.lit(""))


def user_text(ip: Column | str, username: Column | str) -> Column:
    """Name shown for an edit: the address of an anonymous user wins over the name."""
    return F.coalesce(_col(ip), _col(username), F.lit(""))


def user_id(contributor_id: Column | str) -> Column:
    return F.coalesce(_col(contributor_id), F.lit(0).cast("bigint"))


def empty_to_null(c: Column | str) -> Column:
    """An element without content counts as absent."""
    return F.nullif(_col(c), F.lit(""))


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def byte_length(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(_col(text)), F.lit(0)).cast("bigint")


def char_count(text: Column | str) -> Column:
    return F.coalesce(F.char_length(_col(text)), F.lit(0)).cast("bigint")


def text_digest(text: Column | str) -> Column:
    """MD5 of the text; empty and missing text share the empty digest."""
    return F.coalesce(F.md5(empty_to_null(text)), F.lit(""))


def is_redirect(text: Column | str) -> Column:
    """Starts with the redirect word in any ASCII case, and holds a link; null for null text."""
    head = F.substring(_col(text), 1, len(REDIRECT_WORD))
    # (?i) folds ASCII only, unlike upper(), which would also accept a dotless i.
    return head.rlike(f"(?i)^{REDIRECT_WORD}$") & F.contains(_col(text), F.lit(LINK_OPEN))


def extract_categories(text: Column | str) -> Column:
    """All unpiped ``[[Category:NAME]]`` links, in order and with repeats."""
    return F.coalesce(
        F.regexp_extract_all(_col(text), F.lit(CATEGORY_PATTERN), 1),
        F.array().cast("array<string>"),
    )


def page_random(page_id: Column | str, seed: str = "") -> Column:
    """Repeatable uniform number in [0, 1): the first 52 bits of a digest of the page id."""
    digest = F.md5(F.concat(F.lit(seed), _col(page_id).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def drop_tag_blocks(text: Column | str, tag: str) -> Column:
    """Remove the lines from ``<tag>`` to ``</tag>``, both alone on their line.

    A block that is never closed runs to the end; a closing line without an opening one stays. Works on one record
    at a time, so it needs no shuffle. Every line of the result ends in a line break, and no line at all gives ''.
    """
    name = re.escape(tag)
    blank = r"[^\S\n]*"
    block = rf"(?dms)^{blank}<{name}>{blank}$.*?(?:^{blank}</{name}>{blank}\n|\z)"
    return F.regexp_replace(F.concat(_col(text), F.lit("\n")), block, "")


def text_lines(text: Column | str) -> Column:
    """Lines of a text in which every line ends in a line break. Reads ``text`` once, which may be costly to make."""
    return F.regexp_extract_all(_col(text), F.lit("([^\n]*)\n"), 1)
