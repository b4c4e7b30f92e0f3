"""Reading a full-history dump as one row per revision, whatever the size of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import byte_length, empty_to_null, is_redirect, text_digest
from ..schema import CORRUPT, PAGE_HEADER_XML, REVISION_XML
from ..session import materialize
from .dump import PAGE_CLOSE, PAGE_OPEN, XML_OPTIONS

REVISION_OPEN, REVISION_CLOSE = "<revision>", "</revision>"
ROW_BITS = 33
ROW_MASK = (1 << ROW_BITS) - 1


def _virtual_records(value: str) -> Column:
    """A record cut at every revision: (before, rev, cut) for each; only the last revision of a record was closed.

    ``before`` holds what stands between the end of the revision before and this one: the end of a page, headers.
    A revision that never closed ends at the next page, whose header is then read as if nothing had been cut.
    """
    pieces = F.split(value, REVISION_OPEN, -1)
    last = F.size(pieces) - 1

    def piece(i: Column) -> Column:
        return F.element_at(pieces, i + 1)

    def tail(p: Column) -> Column:
        return F.when(F.instr(p, PAGE_OPEN) > 0, F.substr(p, F.instr(p, PAGE_OPEN))).otherwise(F.lit(""))

    alone = F.array(F.struct(piece(F.lit(0)).alias("before"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("cut")))
    cut = F.transform(F.sequence(F.lit(1), last), lambda j: F.struct(
        F.when(j == 1, piece(F.lit(0))).otherwise(tail(piece(j - 1))).alias("before"),
        F.when(j == last, piece(j)).otherwise(F.substring_index(piece(j), PAGE_OPEN, 1)).alias("rev"),
        (j < last).alias("cut")))
    return F.when(last == 0, alone).otherwise(cut)


ENTRIES = "array<struct<header:string,rev:string,cut:boolean>>"


def _entries(record: Column) -> Column:
    """One entry per header, and one for the revision, which takes the last header that did not close."""
    parts = F.split(record["before"], PAGE_OPEN, -1)
    headers = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    closed = F.transform(
        F.filter(headers, lambda h: F.contains(h, F.lit(PAGE_CLOSE))),
        lambda h: F.struct(h.alias("header"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("cut")),
    )
    opened = F.try_element_at(F.filter(headers, lambda h: ~F.contains(h, F.lit(PAGE_CLOSE))), F.lit(-1))
    own = F.when(record["rev"].isNotNull(), F.array(F.struct(opened.alias("header"), record["rev"].alias("rev"), record["cut"].alias("cut"))))
    return F.concat(closed.cast(ENTRIES), F.coalesce(own, F.array()).cast(ENTRIES))


def stage_history(spark: SparkSession, path: str | list[str], with_text: bool = True) -> DataFrame:
    """Parse a dump once and store its revisions as columns: place, page header if there is one, revision, text.

    The closing tag of a revision is the record separator, so a page may be larger than any row or split. A record is
    cut again at every opening tag of a revision: one that never closed is a malformed revision of its own (its text
    in ``_corrupt``), and what follows it is read as usual. A scan and nothing more; the page of a revision without
    header is found by :func:`history_facts`.
    """
    rows = spark.read.option("lineSep", REVISION_CLOSE).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)).alias("row"),
        F.posexplode(F.flatten(F.transform(_virtual_records("value"), _entries))).alias("part", "entry"),
    )
    xml = F.concat(F.lit(REVISION_OPEN), F.col("entry.rev"), F.lit(REVISION_CLOSE))
    parsed = rows.select("*", F.when(F.col("entry.rev").isNotNull(), F.from_xml(xml, f"{REVISION_XML}, {CORRUPT} STRING", XML_OPTIONS)).alias("p"))
    # A revision that never closed names itself by its leading id where the parse could not.
    own_id = F.nullif(F.regexp_extract("entry.rev", r"^\s*<id>(\d+)</id>", 1), F.lit("")).cast("bigint")
    revision = F.when(F.col("entry.cut"), F.col("p").withField(CORRUPT, F.concat(F.lit(REVISION_OPEN), F.col("entry.rev")))
                      .withField("id", F.coalesce("p.id", own_id))).otherwise(F.col("p"))
    parsed = parsed.select("file", "block", "row", "part", "entry", revision.alias("r"))
    text = empty_to_null("r.text")
    header_xml = F.concat(
        F.lit(PAGE_OPEN), F.substring_index("entry.header", PAGE_CLOSE, 1), F.lit(PAGE_CLOSE)
    )
    narrow = parsed.select(
        "file", "block", "row", "part",
        F.when(F.col("entry.header").isNotNull(), F.from_xml(header_xml, PAGE_HEADER_XML, XML_OPTIONS)).alias("h"),
        F.col("r").dropFields("text").alias("r"),
        text_digest("r.text").alias("digest"),
        F.when(text.isNotNull(), byte_length("r.text")).alias("text_bytes"),
        is_redirect(text).cast("int").alias("text_redirect"),
        *([F.col("r.text").alias("text")] if with_text else []),
    )
    page = F.when(F.col("h").isNotNull(), F.struct(
        F.col("h.id").alias("page_id"), F.col("h.title").alias("title"), F.col("h.ns").alias("page_ns"),
        F.col("h.restrictions").alias("restrictions"), F.col("h.redirect._title").alias("redirect_title"),
        "row", "part",
    ))
    return materialize(narrow.withColumn("page", page).drop("h"), "history")


def history_texts(staged: DataFrame) -> DataFrame:
    """(text_at, rev_id, text) of every revision; needs no page context. ``text_at`` is its place in the files."""
    return staged.where(F.col("r.id").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select(_place(), F.col("r.id").alias("rev_id"), "text")


def _place():
    return F.struct("file", "block", "row").alias("text_at")


def history_facts(staged: DataFrame) -> DataFrame:
    """Revision facts in the flat layout.

    A row has the page header only if it is the page's first, so headers are carried forward: inside a split by a
    window over that split's narrow rows, and over split borders by a window with one row per split. Both have a
    bounded size, however many revisions a page has.
    """
    narrow = staged.drop("text")
    split = ["file", "block"]
    so_far = W.partitionBy(*split).orderBy("row", "part").rowsBetween(W.unboundedPreceding, 0)
    inside = narrow.withColumn("page", F.last("page", ignorenulls=True).over(so_far))
    ends = narrow.groupBy(*split).agg(
        F.expr("max_by(page, struct(row, part)) FILTER (WHERE page IS NOT NULL)").alias("last_page")
    )
    # From here to the join there is one row per split, and a window holds those of one file: no page crosses files.
    in_file = W.partitionBy("file").orderBy("block")
    numbered = ends.select(*split, "last_page", (F.row_number().over(in_file) - 1).alias("split_no"))
    last = F.when(F.col("last_page").isNotNull(), F.struct("split_no", F.col("last_page").alias("page")))
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    carried = numbered.select(*split, "split_no", F.last(last, ignorenulls=True).over(before).alias("carry"))
    own = F.when(F.col("page").isNotNull(), F.struct("split_no", "page"))
    placed = inside.join(carried, split).withColumn("head", F.coalesce(own, "carry"))

    def position(split_no: str, row: str):
        return F.shiftleft(F.col(split_no).cast("bigint"), ROW_BITS).bitwiseOR(F.col(row))

    page = "head.page"
    return placed.select(
        f"{page}.page_id",
        F.struct("file", position("head.split_no", f"{page}.row").alias("position"), f"{page}.part").alias("page_seq"),
        position("split_no", "row").alias("rev_seq"), _place(),
        f"{page}.title", F.col("r.id").alias("rev_id"), F.col("r.parentid").alias("parent_id"),
        F.col("r.timestamp").alias("rev_timestamp"), F.col("r.contributor.id").alias("contributor_id"),
        F.col("r.contributor.username").alias("username"), F.col("r.contributor.ip").alias("ip"),
        F.col("r.minor").isNotNull().alias("minor"), F.col("r.comment").alias("comment"),
        F.col("r.model").alias("model"), F.col("r.format").alias("format"), F.col("r.sha1").alias("sha1"),
        f"{page}.redirect_title", f"{page}.page_ns", f"{page}.restrictions", "digest", "text_bytes", "text_redirect",
        F.col(f"r.{CORRUPT}").alias("malformed"), F.col("r").isNotNull().alias("has_revision"),
    )


def scan_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Revision facts of a full-history dump, with digest and length in place of the text."""
    return history_facts(stage_history(spark, path, with_text=False))
