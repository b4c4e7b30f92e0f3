"""Whole conversions: a dump, or flat revisions, to the output tables and what they leave out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_if_null
from ..operators import corpus, ids, tables
from ..operators.joins import lookup
from ..operators.revisions import current_of_page, current_revision, dedup_texts, latest_revision, revision_facts
from ..operators.titles import dedup_elements, drop_redirects, filter_namespaces, page_headers, resolve_namespace
from ..schema import CORRUPT
from ..session import materialize
from ..sources.dump import explode_revisions, scan_dump, scan_namespaces
from ..sources.history import history_facts, history_texts, stage_history

NO_SUCH_PAGE = "page without id or title"
MALFORMED_PAGE = "malformed page"
MALFORMED_REVISION = "malformed revision"
NO_REVISION_ID = "revision without id"
NO_REVISIONS = "page without revisions"
OTHER_NAMESPACE = "namespace not chosen"
REPEATED = "repeated title or id"
REDIRECT = "redirect"


def rejected(rows: DataFrame, reason: str | Column, rev_id: Column | None = None, detail: Column | None = None) -> DataFrame:
    """(reason, page_id, title, rev_id, detail) of what a conversion leaves out; page-level rows have no rev_id."""
    none = F.lit(None)
    return rows.select(
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.col("page_id").cast("bigint").alias("page_id"),
        "title", (none if rev_id is None else rev_id).cast("bigint").alias("rev_id"),
        (none if detail is None else detail).cast("string").alias("detail"))


def _without(facts: DataFrame, dropped: DataFrame) -> DataFrame:
    """Revisions of page elements that are not in ``dropped``; an element of any size is spread over many tasks."""
    marked = lookup(facts, dropped.withColumn("_gone", F.lit(True)), ["page_seq"], ["_gone"], "n_revisions", ["rev_seq"])
    return marked.where(F.col("_gone").isNull()).drop("_gone")


def _chosen_rows(facts: DataFrame, ns: DataFrame, namespaces: Sequence[str]) -> DataFrame:
    """Revisions of the chosen namespaces. Every row carries its title, so the counted list of names is enough."""
    return filter_namespaces(resolve_namespace(facts, ns), ns, namespaces).select(*facts.columns)


def history_tables(
    revs: DataFrame,
    ns: DataFrame,
    texts: DataFrame | None = None,
    namespaces: Sequence[str] | None = None,
    with_text: bool = True,
    renumber: bool = False,
    compress: str = "none",
    raw_timestamps: bool = False,
) -> dict[str, DataFrame]:
    """page, revision, text and rejected tables of the history path.

    ``revs`` is the flat layout with texts, or revision facts with a unique ``text_at`` together with ``texts``
    (text_at, text). All rules work on the narrow facts, which are stored if they are not yet: which elements are
    kept, which text is first, new ids, which text is the latest. The texts join the outcome once, by ``text_at``.

    Pages are elements of the dump. A later element with a known title or a known id is left out with all its
    revisions. Titles hold their namespace, so the namespace filter may come first.
    """
    if "digest" in revs.columns:
        facts = revs.drop("text")
        if with_text and (texts is None or "text_at" not in facts.columns):
            raise ValueError("revision facts need text_at, and texts (text_at, text), for the text table")
    else:
        placed = revs.withColumn("text_at", F.struct("page_seq", "rev_seq"))
        texts = placed.select("text_at", "text")
        facts = materialize(revision_facts(placed), "facts")
    left_out = [rejected(facts.where(F.col("rev_seq").isNotNull() & F.col("rev_id").isNull()), NO_REVISION_ID)]
    # One narrow row per element, used more than once.
    headers = materialize(page_headers(facts), "headers")
    if namespaces:
        chosen = _chosen_rows(headers, ns, namespaces)
        left_out.append(rejected(headers.join(chosen.select("page_seq"), "page_seq", "left_anti"), OTHER_NAMESPACE))
        headers, facts = materialize(chosen, "headers"), _chosen_rows(facts, ns, namespaces)
    pages = materialize(dedup_elements(resolve_namespace(headers, ns)), "pages")
    # Few elements are dropped as a rule. Stored, their real size is known, and the planner broadcasts them if they
    # are small and shuffles them if not.
    dropped = materialize(headers.join(pages.select("page_seq"), "page_seq", "left_anti").select(
        "page_seq", "page_id", "title", "n_revisions"), "dropped")
    left_out.append(rejected(dropped, REPEATED))
    facts = _without(facts.where(F.col("rev_id").isNotNull()), dropped.select("page_seq", "n_revisions"))
    if renumber:
        page_map, rev_map = ids.renumber(pages, facts)
        facts = ids.remap_ids(facts, page_map, rev_map)
        pages = ids.remap_headers(pages, page_map)
    facts = materialize(dedup_texts(facts), "kept")
    out = {
        "page": tables.build_page(pages, facts, raw_timestamps),
        "revision": tables.build_revision(facts, raw_timestamps),
        "rejected": reduce(DataFrame.unionByName, left_out),
    }
    if with_text:
        out["text"] = _first_texts_of(facts, texts, compress)
    return out


def _first_texts_of(facts: DataFrame, texts: DataFrame, compress: str) -> DataFrame:
    """The text table: what is first, and what is latest, is known before the texts are read."""
    firsts = facts.where(F.col("rev_id") == F.col("rev_text_id")).select("text_at", F.col("rev_id").alias("old_id"))
    if compress == "old":
        shown = latest_revision(facts).select(F.col("latest_id").alias("rev_id")).join(
            facts.select("rev_id", "rev_text_id"), "rev_id").select(F.col("rev_text_id").alias("old_id"))
        firsts = firsts.join(shown.withColumn("is_latest", F.lit(True)), "old_id", "left").withColumn(
            "is_latest", F.coalesce("is_latest", F.lit(False)))
    elif compress == "full":
        firsts = firsts.withColumn("is_latest", F.lit(False))
    # The narrow side is the build side, so texts are shuffled but not sorted.
    found = texts.select("text_at", "text").join(firsts.hint("shuffle_hash"), "text_at")
    made = found.select("old_id", blank_if_null("text").alias("old_text"), F.lit("").alias("old_flags"),
                        *(["is_latest"] if compress != "none" else []))
    return tables.compress_text(made, compress)


def current_tables(revs: DataFrame, user: str = "importer") -> dict[str, DataFrame]:
    """The four tables of the current-revision path; ``revs`` needs page_namespace and redirect_title."""
    current = materialize(current_revision(drop_redirects(revs)), "current")  # one pass for four tables
    return _current_tables(current, user)


def _current_tables(current: DataFrame, user: str) -> dict[str, DataFrame]:
    return {
        "page": tables.build_page_current(current),
        "revision": tables.build_revision_current(current, user),
        "text": tables.build_text_current(current),
        "recentchanges": tables.build_recentchanges(current, user),
    }


def stage_dump(
    spark: SparkSession, dump: str | list[str], name: str = "revisions", drop_blocks: Sequence[str] = ()
) -> DataFrame:
    """Parse a dump once and store flat layout and facts as columns; malformed pages keep their text in ``_corrupt``."""
    rows = explode_revisions(scan_dump(spark, dump, drop_blocks))
    facts = revision_facts(rows.withColumn("_text", F.col("text")).withColumn("text_at", F.struct("page_seq", "rev_seq")))
    return materialize(facts.withColumnRenamed("_text", "text"), name)


def _is_good():
    return F.col(CORRUPT).isNull() & F.col("page_id").isNotNull() & F.col("title").isNotNull()


def good_revisions(staged: DataFrame) -> DataFrame:
    return staged.where(_is_good()).drop(CORRUPT)


def bad_pages(staged: DataFrame) -> DataFrame:
    """Pages that are not well formed, with their text, or lack id or title: what a conversion sets aside."""
    first = F.coalesce("rev_seq", F.lit(0)) == 0  # one row a page
    return staged.where(~_is_good() & first).select("page_id", "title", CORRUPT)


def convert_dump(spark: SparkSession, dump: str | list[str], drop_blocks: Sequence[str] = (), **options) -> dict[str, DataFrame]:
    """History path from a dump whose pages fit a row. ``rejected`` has what is in no other table, and why."""
    staged = stage_dump(spark, dump, drop_blocks=drop_blocks)
    good = good_revisions(staged)
    out = history_tables(good.drop("text"), scan_namespaces(spark, dump), texts=good.select("text_at", "text"), **options)
    bad = bad_pages(staged)
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit(MALFORMED_PAGE)).otherwise(F.lit(NO_SUCH_PAGE))
    return out | {"rejected": rejected(bad, reason, detail=F.col(CORRUPT)).unionByName(out["rejected"])}


def convert_history(spark: SparkSession, dump: str | list[str], **options) -> dict[str, DataFrame]:
    """History path from a full-history dump: parsed once, and no step holds a whole page.

    Only a malformed revision is left out, not its page; revisions of a page without id are left out with it.
    """
    staged = stage_history(spark, dump)
    facts = materialize(history_facts(staged), "facts")
    named = F.col("page_id").isNotNull() & F.col("title").isNotNull()
    good = facts.where(F.col("malformed").isNull() & named).drop("malformed")
    out = history_tables(good, scan_namespaces(spark, dump), texts=history_texts(staged), **options)
    bad = facts.where(F.col("malformed").isNotNull() | ~named)
    reason = F.when(F.col("malformed").isNotNull(), F.lit(MALFORMED_REVISION)).otherwise(F.lit(NO_SUCH_PAGE))
    # A header without revisions gives a row without one, which is no revision lacking its id.
    listed = out["rejected"].where(F.col("reason") != NO_REVISION_ID)
    nameless = good.where(F.col("rev_id").isNull() & F.col("has_revision"))
    return out | {"rejected": reduce(DataFrame.unionByName, [
        listed, rejected(nameless, NO_REVISION_ID), rejected(bad, reason, F.col("rev_id"), F.col("malformed"))])}


def convert_current(
    spark: SparkSession, dump: str | list[str], user: str = "importer", drop_blocks: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Current-revision path from a dump, by the rules of the stream; an empty text element counts as a text here.

    A page is one row, so nothing is shuffled or stored before the tables are written; each table parses the dump for
    itself, and only the text table carries texts along.
    """
    pages = scan_dump(spark, dump, drop_blocks)
    bad = pages.where(F.col(CORRUPT).isNotNull() | F.col("id").isNull() | F.col("title").isNull())
    good = pages.where(F.col(CORRUPT).isNull() & F.col("id").isNotNull() & F.col("title").isNotNull())
    flat = good.select(F.col("id").alias("page_id"), "title", "redirect", "revision")
    is_redirect = F.col("redirect").isNotNull()
    has_none = ~F.exists(F.coalesce("revision", F.array()), lambda r: r["id"].isNotNull())
    nameless = flat.where(~is_redirect).select("page_id", "title", F.explode("revision").alias("r")).where(F.col("r.id").isNull())
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit(MALFORMED_PAGE)).otherwise(F.lit(NO_SUCH_PAGE))
    left_out = [
        rejected(bad.withColumnRenamed("id", "page_id"), reason, detail=F.col(CORRUPT)),
        rejected(flat.where(is_redirect), REDIRECT),
        rejected(flat.where(~is_redirect & has_none), NO_REVISIONS),
        rejected(nameless, NO_REVISION_ID),
    ]
    return _current_tables(current_of_page(pages), user) | {"rejected": reduce(DataFrame.unionByName, left_out)}


def create_corpus(spark: SparkSession, dump: str | list[str], path: str, drop_blocks: Sequence[str] = ()) -> None:
    """A corpus from a dump: one folder per category below ``path`` with the current text of each page."""
    current = current_of_page(scan_dump(spark, dump, drop_blocks), keep=["page_seq"])
    stored = materialize(current.select("page_id", "page_seq", "text"), "articles")
    corpus.write_corpus(corpus.corpus_rows(stored), path)


def main_articles(spark: SparkSession, dump: str | list[str], batch_size: int = 1000, drop_blocks: Sequence[str] = ()) -> DataFrame:
    """(page_id, rank, batch, article, categories): latest articles of the main namespace, numbered in batches."""
    made = convert_dump(spark, dump, drop_blocks)
    page, revision, text = (materialize(made[t], t) for t in ("page", "revision", "text"))
    main = page.where(F.col("page_namespace") == 0)
    batches = ids.batch_ids(main, batch_size)
    records = corpus.article_record(corpus.article_lookup(main, revision, text))
    return batches.join(records, "page_id")
