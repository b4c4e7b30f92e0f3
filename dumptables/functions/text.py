"""Output-side text rules: byte repair, escaping, compression."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import _col

# The compression threshold in bytes, the row flag, and the escapes of the text formats.
COMPRESS_MIN_BYTES = 512
COMPRESSED_FLAG = "gzip"
ESCAPES = [("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")]
QUOTES = ["'", '"']

# Byte classes of UTF-8, written for a string whose characters stand for single bytes.
_TAIL = "[\\x80-\\xBF]"
_LEAD2, _LEAD3, _LEAD4 = "[\\xC0-\\xDF]", "[\\xE0-\\xEF]", "[\\xF0-\\xF7]"
_LEAD5, _LEAD6 = "[\\xF8-\\xFB]", "[\\xFC-\\xFD]"

# A sequence that needs more bytes than are left.
_CUT_OFF = f"(?s)(?:{_LEAD2}|{_LEAD3}.?|{_LEAD4}.{{0,2}}|{_LEAD5}.{{0,3}}|{_LEAD6}.{{0,4}})\\z"
# Complete sequences that are overlong or encode more than 21 bits. The look ahead lets ASCII fail at once.
_ANY_LEAD = "(?=[\\xC0-\\xFF])"
_REDUNDANT = (
    f"{_ANY_LEAD}(?:[\\xC0\\xC1]{_TAIL}|\\xE0[\\x80-\\x9F]{_TAIL}|\\xF0[\\x80-\\x8F]{_TAIL}{{2}}"
    f"|{_LEAD5}{_TAIL}{{4}}|{_LEAD6}{_TAIL}{{5}})"
)
_BROKEN_LEAD = (
    f"{_ANY_LEAD}(?:{_LEAD2}(?!{_TAIL})|{_LEAD3}(?!{_TAIL}{{2}})|{_LEAD4}(?!{_TAIL}{{3}})|[\\xF8-\\xFF])"
)
# The byte class comes before the look back, so that only tail bytes pay for it.
_STRAY_TAIL = (
    f"{_TAIL}(?<!(?:{_LEAD2}|{_LEAD3}|{_LEAD3}{_TAIL}|{_LEAD4}|{_LEAD4}{_TAIL}|{_LEAD4}{_TAIL}{{2}}){_TAIL})"
)
_LONGEST_CUT = 5  # bytes that a cut-off sequence can have


def sanitize_text(text: Column | str) -> Column:
    """Drop NUL; one '?' for each malformed byte or redundant sequence; drop a sequence cut off at the end.

    Takes STRING or BINARY. Valid text, nearly all of it, takes the first branch; the byte rules see only the rest.
    """
    raw = _col(text)
    as_text = raw.cast("string")
    data = raw.cast("binary")
    cut = F.greatest(F.octet_length(data) - _LONGEST_CUT, F.lit(0))
    body, end = F.substr(data, F.lit(1), cut), F.substr(data, cut + 1)
    latin = F.concat(
        F.decode(body, "ISO-8859-1"), F.regexp_replace(F.decode(end, "ISO-8859-1"), _CUT_OFF, "")
    )
    for pattern in (_REDUNDANT, _BROKEN_LEAD, _STRAY_TAIL):
        latin = F.regexp_replace(latin, pattern, "?")
    repaired = F.encode(latin, "ISO-8859-1").cast("string")
    nul = F.char(F.lit(0))
    return F.when(F.is_valid_utf8(as_text), F.replace(as_text, nul, F.lit(""))).otherwise(
        F.replace(repaired, nul, F.lit(""))
    )


def escape_value(value: Column | str, quotes: bool = False) -> Column:
    """Backslash escapes for one-line text formats; quotes only where values are quoted."""
    out = _col(value)
    for char, escape in ESCAPES + ([(q, "\\" + q) for q in QUOTES] if quotes else []):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def escape_bytes(value: Column | str, quotes: bool = False) -> Column:
    """As :func:`escape_value` for BINARY, where NUL is kept as an escape."""
    out = escape_value(_col(value).cast("string"), quotes)
    return F.replace(out, F.char(F.lit(0)), F.lit("\\0"))


@F.pandas_udf(T.BinaryType())
def deflate(text: pd.Series) -> pd.Series:
    """Raw deflate, best compression; Spark has no built-in for it."""

    def pack(value: str | None) -> bytes | None:
        if value is None:
            return None
        packer = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS, 9)
        return packer.compress(value.encode("utf-8")) + packer.flush()

    return text.map(pack, na_action=None)


@F.pandas_udf(T.StringType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda v: None if v is None else zlib.decompress(bytes(v), -zlib.MAX_WBITS).decode("utf-8"),
                    na_action=None)
