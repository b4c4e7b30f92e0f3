"""Titles and namespaces of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_title
from .joins import checked_broadcast
from .revisions import single_text


def page_headers(revs: DataFrame) -> DataFrame:
    """One row per page element from the flat revision layout, with its revision count and, from facts, ``is_new``.

    An element is one place in the dump (``page_seq``); a dump that was restarted can hold a page in two of them.
    """
    extra = [F.first(c).alias(c) for c in ("restrictions", "redirect_title", "page_ns") if c in revs.columns]
    if "digest" in revs.columns:
        extra.append(single_text().alias("is_new"))
    return revs.groupBy("page_seq").agg(
        F.first("page_id").alias("page_id"),
        F.first("title").alias("title"),
        *extra,
        F.count("rev_id").alias("n_revisions"),
    )


def namespace_names(ns: DataFrame) -> DataFrame:
    """Named namespaces under their normalised name; the first in list order wins."""
    return (
        ns.where(F.col("ns_name") != "")
        .groupBy(normalize_title("ns_name").alias("ns_prefix"))
        .agg(F.min_by("ns_id", "ns_pos").alias("ns_id"))
    )


def resolve_namespace(pages: DataFrame, ns: DataFrame) -> DataFrame:
    """Add ``full_title``, ``page_namespace`` and ``page_title`` (the title without its namespace prefix).

    A namespace name holds no colon, so "title starts with name and colon" is an equality on the first part.
    """
    full = normalize_title("title")
    prefixed = pages.withColumn("full_title", full).withColumn(
        "ns_prefix", F.when(F.contains("full_title", F.lit(":")), F.substring_index("full_title", ":", 1))
    )
    found = prefixed.join(checked_broadcast(namespace_names(ns), ns), "ns_prefix", "left")
    rest = F.substr("full_title", F.char_length("ns_prefix") + 2)
    return found.select(
        *pages.columns,
        "full_title",
        F.coalesce("ns_id", F.lit(0)).cast("int").alias("page_namespace"),
        F.when(F.col("ns_id").isNull(), F.col("full_title")).otherwise(rest).alias("page_title"),
    )


def dedup_titles(pages: DataFrame) -> DataFrame:
    """The first page in document order keeps its title.

    An aggregate, not a window: map-side combine leaves one row per title and task, however often a title occurs.
    """
    return _first_of(pages, "full_title")


def _first_of(pages: DataFrame, key: str) -> DataFrame:
    rest = [c for c in pages.columns if c != key]
    first = pages.groupBy(key).agg(F.min_by(F.struct(*rest), "page_seq").alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.{c}") for c in pages.columns])


def dedup_elements(pages: DataFrame) -> DataFrame:
    """Page elements that are kept: the first with a title, and of these the first with an id.

    A later element is left out with all its revisions, also where it has the same id and another title.
    """
    return _first_of(dedup_titles(pages), "page_id")


def report_duplicate_titles(pages: DataFrame) -> DataFrame:
    """The pages that :func:`dedup_titles` drops."""
    first = pages.groupBy("full_title").agg(F.min("page_seq").alias("page_seq"))
    # page_seq is unique, so the join key spreads the copies of one title.
    return pages.join(first, ["full_title", "page_seq"], "left_anti").select(*pages.columns)


def _chosen(ns: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(token, ns_id) for every token; ns_id is null where nothing matches. Sized by the user's list."""
    listed = F.array(*[F.lit(t) for t in tokens])
    wanted = ns.sparkSession.range(1).select(F.explode(listed).alias("token")).distinct()
    by_number = F.col("token").rlike("^[0-9]+$")
    key = F.when(by_number, F.concat(F.lit("#"), F.expr("try_cast(token AS BIGINT)").cast("string"))).otherwise(
        F.lower(normalize_title("token"))
    )
    # A namespace answers to its number and to its name; "#" cannot start a title, so the two never meet.
    keys = F.array_compact(F.array(F.concat(F.lit("#"), F.col("ns_id").cast("string")),
                                   F.lower(normalize_title("ns_name"))))
    known = ns.select("ns_pos", "ns_id", F.explode(keys).alias("_key"))
    return (
        wanted.withColumn("_key", key)
        .join(checked_broadcast(known, ns), "_key", "left")
        .groupBy("token")
        .agg(F.min_by("ns_id", "ns_pos").alias("ns_id"))
    )


def filter_namespaces(pages: DataFrame, ns: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Keep pages of the chosen namespaces; a token is a number or a name (any case)."""
    chosen = _chosen(ns, tokens).where(F.col("ns_id").isNotNull())
    wanted = chosen.select(F.col("ns_id").cast("int").alias("page_namespace")).distinct()
    # No more rows than tokens given.
    return pages.join(F.broadcast(wanted), "page_namespace", "left_semi").select(*pages.columns)


def unmatched_namespaces(ns: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Tokens that name no namespace."""
    return _chosen(ns, tokens).where(F.col("ns_id").isNull()).select("token")


def filter_main_ns(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_namespace") == 0)


def count_main_ns(pages: DataFrame) -> DataFrame:
    return filter_main_ns(pages).agg(F.count(F.lit(1)).alias("n_pages"))


def drop_redirects(pages: DataFrame, column: str = "redirect_title") -> DataFrame:
    """Drop pages that carry a redirect element."""
    return pages.where(F.col(column).isNull())
