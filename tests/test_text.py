import random
import re

from pyspark.sql import functions as F

from dumptables.functions import columns as fc
from dumptables.functions import text as ft
from dumptables.operators import tables


def repaired(data: bytes) -> bytes:
    """The byte rules, one byte at a time."""
    out, i = bytearray(), 0
    lengths = [(0xC0, 0xDF, 2, 0x80), (0xE0, 0xEF, 3, 0x800), (0xF0, 0xF7, 4, 0x10000), (0xF8, 0xFB, 5, None),
               (0xFC, 0xFD, 6, None)]
    while i < len(data):
        b = data[i]
        if b < 0x80:
            out += bytes([b]) if b else b""
            i += 1
            continue
        size = next((s for low, high, s, _ in lengths if low <= b <= high), 1)
        least = next((m for low, high, _, m in lengths if low <= b <= high), None)
        if size == 1:
            out += b"?"
            i += 1
        elif i + size > len(data):
            break
        elif any(not 0x80 <= t <= 0xBF for t in data[i + 1:i + size]):
            out += b"?"
            i += 1
        else:
            value = b & (0xFF >> (size + 1))
            for t in data[i + 1:i + size]:
                value = value << 6 | t & 0x3F
            out += b"?" if least is None or value < least else data[i:i + size]
            i += size
    return bytes(out)


def test_sanitize_against_the_byte_rules(spark):
    rng = random.Random(7)
    pool = [0x00, 0x41, 0x5C, 0x80, 0x9F, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xF7, 0xF9, 0xFC, 0xFE, 0xFF]
    samples = [bytes(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    samples += ["aé€𝄞".encode(), "� ok".encode(), b"caf\xc3", b"\xe2\x82A", b"\xc0\x80x"]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(samples)], "i INT, data BINARY")
    rows = df.select("i", ft.sanitize_text("data").cast("binary").alias("clean")).collect()
    for r in rows:
        assert bytes(r.clean) == repaired(samples[r.i]), samples[r.i]


def test_escapes(spark):
    df = spark.createDataFrame([("a\\b\tc\nd\re'f\"",)], "v STRING")
    row = df.select(ft.escape_value("v").alias("p"), ft.escape_value("v", quotes=True).alias("q")).first()
    assert row.p == "a\\\\b\\tc\\nd\\re'f\""
    assert row.q == "a\\\\b\\tc\\nd\\re\\'f\\\""


def test_redirect_rule(spark):
    texts = ["#redirect [[A]]", "#REDIRECT A", " #REDIRECT [[A]]", "#REDıRECT [[A]]", "", None, "#REDIRECT[["]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r.r for r in df.select(fc.is_redirect("t").alias("r")).collect()] == [
        True, False, False, False, False, None, True]


def test_categories(spark):
    text = "[[Category:A b-_1]] [[Category:P|k]] [[category:x]] [[Category:A b-_1]] [[Category:é]] [[Category:L\nM]]"
    df = spark.createDataFrame([(text,), ("none",), (None,)], "t STRING")
    rows = [r.c for r in df.select(fc.extract_categories("t").alias("c")).collect()]
    assert rows == [["A b-_1", "A b-_1", "L\nM"], [], []]


def test_small_rules(spark):
    df = spark.createDataFrame([("2005-08-31T01:02:03Z", ""), (None, None)], "ts STRING, v STRING")
    rows = df.select(fc.timestamp_digits("ts").alias("d"), fc.empty_to_null("v").alias("n"),
                     fc.text_digest("v").alias("h"), fc.char_count("v").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("20050831010203", None, "", 0), ("", None, "", 0)]
    assert 0 <= spark.range(1000).select(F.min(fc.page_random("id"))).first()[0] < 0.01
    assert 0.99 < spark.range(1000).select(F.max(fc.page_random("id"))).first()[0] < 1


def kept_lines(lines, tag):
    out, inside = [], False
    for line in lines:
        if inside:
            inside = line.strip() != f"</{tag}>"
        elif line.strip() == f"<{tag}>":
            inside = True
        else:
            out.append(line)
    return out


def test_tag_blocks_against_a_line_loop(spark):
    rng = random.Random(3)
    choice = ["<T>", "</T>", " <T>  ", "\t</T>", "a", "", "x <T>", "<T>x", "b"]
    texts = ["\n".join(rng.choice(choice) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    rows = df.select("i", fc.text_lines(fc.drop_tag_blocks("t", "T")).alias("lines")).collect()
    for r in rows:
        assert r.lines == kept_lines(texts[r.i].split("\n"), "T"), texts[r.i]


def test_compression_policies(spark):
    long, short = "é" * 600, "x" * 511
    text = spark.createDataFrame([(1, long, ""), (2, short, ""), (3, long + "3", "")],
                                 "old_id BIGINT, old_text STRING, old_flags STRING")
    latest = spark.createDataFrame([(3,)], "old_id BIGINT")
    full = {r.old_id: r for r in tables.compress_text(text, "full").collect()}
    assert [full[i].old_flags for i in (1, 2, 3)] == ["gzip", "", "gzip"]
    old = tables.compress_text(text, "old", latest)
    flags = {r.old_id: r.old_flags for r in old.collect()}
    assert flags == {1: "gzip", 2: "", 3: ""}
    packed = tables.compress_text(text, "full").where("old_flags = 'gzip'")
    back = {r.old_id: r.t for r in packed.select("old_id", ft.inflate("old_text").alias("t")).collect()}
    assert back == {1: long, 3: long + "3"}
    assert tables.compress_text(text, "none") is text


def test_pattern_is_the_documented_one():
    assert re.findall(fc.CATEGORY_PATTERN, "[[Category:A]]") == ["A"]
