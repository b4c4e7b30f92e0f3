"""Per-page rules over revisions. Text stays out of every shuffle here: the rules see its digest and length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import byte_length, empty_to_null, is_redirect, text_digest
from ..schema import CORRUPT
from .joins import HOT_ROWS, lookup

# Revisions of one page are walked in runs of 2^RUN_BITS positions. rev_seq is unique within a page, so a run never
# holds more rows than that, however large the page.
RUN_BITS = 16


def revision_facts(revs: DataFrame) -> DataFrame:
    """Replace the text by ``digest``, ``text_bytes`` and ``text_redirect`` (the last two null for empty text)."""
    text = empty_to_null("text")
    rest = [c for c in revs.columns if c != "text"]
    return revs.select(
        *rest,
        text_digest("text").alias("digest"),
        F.when(text.isNotNull(), byte_length("text")).alias("text_bytes"),
        is_redirect(text).cast("int").alias("text_redirect"),
    )


def first_texts(facts: DataFrame) -> DataFrame:
    """(page_id, digest) → id of the first revision holding that text, and how many revisions hold it."""
    return facts.groupBy("page_id", "digest").agg(
        F.min_by("rev_id", "rev_seq").alias("rev_text_id"), F.count(F.lit(1)).alias("n_uses")
    )


def dedup_texts(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``rev_text_id``: equal texts of a page share the id of their first revision.

    Only repeated texts are looked up; most texts occur once, and their text id is the revision's own.
    """
    repeated = first_texts(facts).where(F.col("n_uses") > 1)
    rows = lookup(
        facts, repeated, ["page_id", "digest"], ["rev_text_id"], "n_uses", ["rev_seq"], "left", hot_rows
    )
    return rows.withColumn("rev_text_id", F.coalesce("rev_text_id", "rev_id"))


def latest_revision(facts: DataFrame, run_bits: int = RUN_BITS) -> DataFrame:
    """Per page: ``latest_id``, ``touched``, ``text_len`` and ``is_redirect``.

    In document order a revision becomes the latest when its timestamp is strictly greater than all before it;
    length and redirect flag change only if that revision has text. The running maximum is taken in two levels, within
    runs of bounded size and then over one row per run, so a page is never gathered in one task. ``rev_seq`` should
    be close to a count, as the scans make it: the fewer positions a run skips, the fewer runs there are.
    """
    ts = F.coalesce("rev_timestamp", F.lit(""))
    rows = facts.select(
        "page_id", "rev_seq", "rev_id", "text_bytes", "text_redirect",
        ts.alias("ts"), F.shiftright("rev_seq", run_bits).alias("run"),
    )
    before = W.partitionBy("page_id", "run").orderBy("rev_seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("prev", F.max("ts").over(before))
    leads = F.col("prev").isNull() | (F.col("ts") > F.col("prev"))
    has_text = F.col("text_bytes").isNotNull()
    with_text = F.struct("ts", "text_bytes", "text_redirect")
    runs = rows.where(leads).groupBy("page_id", "run").agg(
        F.max("ts").alias("ts"),
        F.max_by("rev_id", "ts").alias("rev_id"),
        F.max(F.when(has_text, with_text)).alias("text"),
    )
    earlier = W.partitionBy("page_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("prev", F.max("ts").over(earlier))
    text_leads = F.col("text").isNotNull() & (F.col("prev").isNull() | (F.col("text.ts") > F.col("prev")))
    return (
        runs.groupBy("page_id")
        .agg(
            # leads again: a run whose maximum only equals an earlier one changes nothing
            F.max(F.when(leads, F.struct("ts", "rev_id"))).alias("latest"),
            F.max(F.when(text_leads, F.col("text"))).alias("text"),
        )
        .select(
            "page_id",
            F.col("latest.rev_id").alias("latest_id"),
            F.col("latest.ts").alias("touched"),
            F.coalesce("text.text_bytes", F.lit(0)).cast("bigint").alias("text_len"),
            F.coalesce("text.text_redirect", F.lit(0)).cast("int").alias("is_redirect"),
        )
    )


def single_text_pages(facts: DataFrame) -> DataFrame:
    """(page_id, is_new): 1 where a page has exactly one distinct text."""
    return facts.groupBy("page_id").agg(single_text().alias("is_new"))


def single_text() -> Column:
    """Aggregate over the facts of a page. No distinct needed: there is one text if lowest and highest digest agree."""
    digest = F.when(F.col("rev_id").isNotNull(), F.col("digest"))
    return F.when(F.min(digest) == F.max(digest), F.lit(1)).otherwise(F.lit(0))


def text_counts(facts: DataFrame) -> DataFrame:
    """(page_id, n_texts): distinct texts per page, reduced by (page, digest) before the page key is shuffled."""
    return facts.groupBy("page_id", "digest").agg(F.lit(1).alias("one")).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_texts")
    )


def page_rollup(facts: DataFrame, run_bits: int = RUN_BITS) -> DataFrame:
    """Per page: latest revision, distinct texts, and ``is_new`` (one distinct text)."""
    counts = text_counts(facts).select(
        "page_id", "n_texts", F.when(F.col("n_texts") == 1, 1).otherwise(0).alias("is_new")
    )
    return latest_revision(facts, run_bits).join(counts, "page_id")


CURRENT_FIELDS = ["rev_id", "parent_id", "rev_timestamp", "sha1", "model", "format", "text"]


def current_revision(revs: DataFrame) -> DataFrame:
    """Per page and field the last value present in revision order.

    An aggregate with map-side combine: what is shuffled is one candidate per page and task, text included.
    """
    last = [F.max_by(c, "rev_seq").alias(c) if c == "rev_id" else
            F.expr(f"max_by({c}, rev_seq) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in CURRENT_FIELDS]
    header = [F.first(c).alias(c) for c in ("title", "page_namespace", "redirect_title") if c in revs.columns]
    return revs.groupBy("page_id").agg(F.min("page_seq").alias("page_seq"), *header, *last)


def current_of_page(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Current revision of each nested page: per field the last value present. No shuffle, so it also streams.

    Redirects, malformed pages, revisions without id, and pages without any revision that has one are left out.
    """
    given = F.filter("revision", lambda r: r["id"].isNotNull())

    def last(field: str):
        values = F.transform("_given", lambda r: r[field])
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    good = pages.where(F.col(CORRUPT).isNull() & F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("redirect").isNull())
    return good.withColumn("_given", given).where(F.size("_given") > 0).select(
        F.col("id").alias("page_id"), "title", *keep,
        F.coalesce("ns", F.lit(0)).alias("page_namespace"),
        last("id").alias("rev_id"), last("timestamp").alias("rev_timestamp"), last("sha1").alias("sha1"),
        last("text").alias("text"),
    )
