"""The registered queries: each operator over the whole seed views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import text as ft
from ..operators import corpus, ids, sinks, tables, titles
from ..operators import revisions as rv
from ..operators.pages_map import map_pages
from ..schema import CORRUPT
from ..session import materialize, scratch_path
from ..sources import dump, history
from ..streaming import ingest
from . import convert, seeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEEP_NAMESPACES = ["0", "user talk"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs -----------------------------------------------------------------------------------------------------


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return rv.revision_facts(seeds.revs(spark, sf))


def _page_table(facts: DataFrame) -> DataFrame:
    headers = titles.page_headers(facts)
    return tables.build_page(titles.resolve_namespace(headers, seeds.nslist(facts.sparkSession)), facts)


def _history_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    revs = seeds.revs(spark, sf)
    facts = rv.revision_facts(revs)
    return {"page": _page_table(facts), "revision": tables.build_revision(facts), "text": tables.build_text(revs)}


def _doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the docs view: as many pages as documents."""
    pages = seeds.docs(spark, sf).select("page_id", "page_seq", "title")
    return titles.resolve_namespace(pages, seeds.nslist(spark))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    revs = titles.resolve_namespace(seeds.revs(spark, sf), seeds.nslist(spark))
    return rv.current_revision(revs)


def _doc_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_text(seeds.docs_as_revisions(seeds.docs(spark, sf)))


def _revs_dump(spark: SparkSession, sf: str, compression: str = "none", broken=None) -> list[str]:
    path = scratch_path(spark, "dump")
    seeds.write_dump(seeds.revs(spark, sf), seeds.nslist(spark), path, compression, broken)
    return seeds.dump_files(path)


def _docs_dump(spark: SparkSession, sf: str, compression: str = "none") -> list[str]:
    path = scratch_path(spark, "dump")
    seeds.write_dump(seeds.docs_as_revisions(seeds.docs(spark, sf)), seeds.nslist(spark), path, compression)
    return seeds.dump_files(path)


# --- sources ----------------------------------------------------------------------------------------------------


def _scanned(pages: DataFrame) -> DataFrame:
    one = F.col("revision")[0]
    return pages.select(
        F.col("id").alias("page_id"), F.col("ns").alias("page_ns"), "title",
        F.col("redirect._title").alias("redirect_title"), F.size("revision").alias("n_revisions"),
        one["id"].alias("rev_id"), one["contributor"]["username"].alias("username"), one["sha1"].alias("sha1"),
        one["text"].alias("text"),
    )


@query
def scan_dump(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(dump.scan_dump(spark, _docs_dump(spark, sf)))


@query
def scan_cut_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth page of the dump never closes: each is set aside under its own id and title, every other page kept."""
    path = scratch_path(spark, "dump")
    seeds.write_dump(seeds.docs_as_revisions(seeds.docs(spark, sf)), seeds.nslist(spark), path, cut=F.col("page_id") % 10 == 3)
    good, bad = dump.quarantine_malformed(dump.scan_dump(spark, seeds.dump_files(path)))
    state = F.when(F.col(CORRUPT).isNotNull(), F.lit("cut")).otherwise(F.lit("nameless"))
    return good.select(F.col("id").alias("page_id"), "title", F.lit("kept").alias("state")).unionByName(
        bad.select(F.col("id").alias("page_id"), "title", state.alias("state")))


@query
def scan_dump_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of namespaces 0 and 3 only; the others are left out by their header, before they are parsed."""
    return _scanned(dump.scan_dump(spark, _docs_dump(spark, sf), namespaces=[0, 3]))


@query
def scan_dump_bz2(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(dump.scan_dump(spark, _docs_dump(spark, sf, "bzip2")))


@query
def explode_revisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = dump.explode_revisions(dump.scan_dump(spark, _revs_dump(spark, sf)))
    return rows.select(
        "page_id", F.col("rev_seq").alias("rev_pos"), "title", "rev_id", "parent_id", "rev_timestamp",
        "contributor_id", "username", "ip", "minor", "comment", "model", "format", "sha1",
        fc.empty_to_null("text").alias("text"),
    )


@query
def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.scan_history(spark, _revs_dump(spark, sf))
    return rows.select(
        "page_id", "title", "rev_id", "parent_id", "rev_timestamp", "contributor_id", "username", "ip", "minor",
        "comment", "model", "format", "sha1", "digest", "text_bytes", "text_redirect",
    )


@query
def scan_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    return dump.scan_namespaces(spark, _docs_dump(spark, sf))


@query
def drop_tag_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = seeds.tagged_docs(seeds.docs(spark, sf))
    kept = fc.text_lines(fc.drop_tag_blocks("text", seeds.BLOCK_TAG))
    return pages.select("page_id", F.posexplode(kept).alias("pos", "line"))


@query
def quarantine_malformed(spark: SparkSession, sf: str) -> DataFrame:
    pages = dump.scan_dump(spark, _revs_dump(spark, sf, broken=F.col("page_id") % 10 == 3))
    good, bad = dump.quarantine_malformed(pages)
    good = good.select(F.col("id").alias("page_id"), F.lit("good").alias("status"))
    number = F.regexp_extract(dump.CORRUPT, "<id>x([0-9]+)</id>", 1)
    return good.unionByName(bad.select(number.cast("bigint").alias("page_id"), F.lit("bad").alias("status")))


# --- sinks ------------------------------------------------------------------------------------------------------


@query
def write_tables(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tables")
    sinks.write_tables(_history_tables(spark, sf), path)
    page = spark.read.parquet(f"{path}/page")
    revision = spark.read.parquet(f"{path}/revision")
    text = spark.read.parquet(f"{path}/text")
    return corpus.article_lookup(page, revision, text)


@query
def write_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    sinks.write_tsv(_doc_text(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def write_mysql_insert(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "insert")
    sinks.write_mysql_insert(materialize(_doc_text(spark, sf), "text"), "text", path, ["old_id"])
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.where(F.col("line").rlike("^(INSERT INTO `text` VALUES |,)\\("))


@query
def write_mysql_revision(spark: SparkSession, sf: str) -> DataFrame:
    """A table with numbers, strings and nulls as INSERT statements."""
    path = scratch_path(spark, "insert")
    revision = materialize(tables.build_revision(_facts(spark, sf)), "revision")
    sinks.write_mysql_insert(revision, "revision", path, ["rev_id"])
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.where(F.col("line").rlike("^(INSERT INTO `revision` VALUES |,)\\("))


@query
def write_tsv_page(spark: SparkSession, sf: str) -> DataFrame:
    """A table with nulls and a double, read back by field."""
    path = scratch_path(spark, "tsv")
    page = _page_table(_facts(spark, sf))
    sinks.write_tsv(page, path)
    fields = F.split("value", "\t", -1)
    names = page.columns
    return spark.read.text(path).select(*[
        fields[n].cast("double").alias(c) if c == "page_random" else fields[n].alias(c) for n, c in enumerate(names)])


@query
def write_pg_copy(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "copy")
    revision = materialize(tables.build_revision(_facts(spark, sf), raw_timestamps=True), "revision")
    sinks.write_pg_copy(revision, "revision", path, ["rev_id"])
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.where(F.contains("line", F.lit("\t")))


@query
def write_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    corpus.write_corpus(corpus.corpus_rows(seeds.docs(spark, sf)), path)
    return spark.read.schema("ordinal BIGINT, article STRING, category STRING").parquet(path)


def _database_counts(spark: SparkSession, sf: str, truncate: bool) -> DataFrame:
    """Rows of each table of a new database, which is dropped when they are counted."""
    name = f"dumptables_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, 'database')}'")
    try:
        tables.create_tables(spark, name)
        for table, df in _history_tables(spark, sf).items():
            df.write.insertInto(f"{name}.{table}")
        if truncate:
            tables.truncate_tables(spark, name)
        return materialize(_row_counts({t: spark.table(f"{name}.{t}") for t in tables.TABLES}), "counts")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _row_counts(made: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
              for t, df in made.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def create_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _database_counts(spark, sf, truncate=False)


@query
def truncate_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _database_counts(spark, sf, truncate=True)


@query
def skip_text(spark: SparkSession, sf: str) -> DataFrame:
    made = convert.history_tables(seeds.revs(spark, sf), seeds.nslist(spark), with_text=False)
    return _row_counts({t: made[t] for t in ("page", "revision")})


# --- tables -----------------------------------------------------------------------------------------------------


@query
def build_page(spark: SparkSession, sf: str) -> DataFrame:
    return _page_table(_facts(spark, sf))


@query
def build_revision(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_revision(_facts(spark, sf))


@query
def build_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_text(seeds.revs(spark, sf))


@query
def build_page_current(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_page_current(_current(spark, sf))


@query
def build_revision_current(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_revision_current(_current(spark, sf))


@query
def build_text_current(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_text_current(_current(spark, sf))


@query
def build_recentchanges(spark: SparkSession, sf: str) -> DataFrame:
    return tables.build_recentchanges(_current(spark, sf))


@query
def article_record(spark: SparkSession, sf: str) -> DataFrame:
    revs = seeds.docs_as_revisions(seeds.docs(spark, sf))
    facts = rv.revision_facts(revs)
    articles = corpus.article_lookup(_page_table(facts), tables.build_revision(facts), tables.build_text(revs))
    # DuckDB and Spark hash arrays differently; one string keeps order and repeats.
    return corpus.article_record(articles).withColumn("categories", F.array_join("categories", "|"))


# --- filters ----------------------------------------------------------------------------------------------------


@query
def filter_main_ns(spark: SparkSession, sf: str) -> DataFrame:
    return titles.filter_main_ns(_doc_pages(spark, sf)).select("page_id", "page_title")


@query
def filter_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    pages = titles.filter_namespaces(_doc_pages(spark, sf), seeds.nslist(spark), KEEP_NAMESPACES)
    return pages.select("page_id", "page_namespace", "page_title")


@query
def drop_redirects(spark: SparkSession, sf: str) -> DataFrame:
    return titles.drop_redirects(seeds.docs(spark, sf)).select("page_id", "title", "text")


@query
def is_redirect(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.revs(spark, sf).select("rev_id", fc.is_redirect("text").alias("is_redirect"))


# --- scalar functions -------------------------------------------------------------------------------------------


@query
def normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.docs(spark, sf).select("page_id", fc.normalize_title("title").alias("full_title"))


@query
def timestamp_digits(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.revs(spark, sf).select("rev_id", fc.timestamp_digits("rev_timestamp").alias("rev_timestamp"))


@query
def user_text(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.revs(spark, sf).select(
        "rev_id", fc.user_id("contributor_id").alias("rev_user"), fc.user_text("ip", "username").alias("rev_user_text")
    )


@query
def empty_to_null(spark: SparkSession, sf: str) -> DataFrame:
    blank = fc.blank_if_null("comment")
    return seeds.revs(spark, sf).select(
        "rev_id", fc.empty_to_null(blank).alias("comment"), blank.alias("written_comment")
    )


@query
def text_length(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.docs(spark, sf).select(
        "page_id", fc.byte_length("text").alias("n_bytes"), fc.char_count("text").alias("n_chars")
    )


@query
def text_digest(spark: SparkSession, sf: str) -> DataFrame:
    return seeds.revs(spark, sf).select("rev_id", fc.text_digest("text").alias("digest"))


@query
def extract_categories(spark: SparkSession, sf: str) -> DataFrame:
    names = fc.extract_categories("text")
    return seeds.docs(spark, sf).select("page_id", F.posexplode(names).alias("pos", "category"))


@query
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    """A NUL inside valid text, and bytes that are no UTF-8: a bad byte, an overlong sequence, a cut-off end."""
    dirty = F.concat(F.col("text"), F.char(F.lit(0)), F.col("title"))
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFC080")), F.col("title").cast("binary"),
                   F.unhex(F.lit("E282")))
    return seeds.docs(spark, sf).select(
        "page_id", ft.sanitize_text(dirty).alias("clean"), ft.sanitize_text(raw).alias("repaired")
    )


@query
def escape_value(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.col("text"), *[F.char(F.lit(c)) for c in (9, 92, 39, 34, 13)])
    return seeds.docs(spark, sf).select(
        "page_id", ft.escape_value(dirty).alias("plain"), ft.escape_value(dirty, quotes=True).alias("quoted")
    )


@query
def compress_text(spark: SparkSession, sf: str) -> DataFrame:
    """Policy "old": the first text of a page counts as its latest where the page number is a multiple of three."""
    text = _doc_text(spark, sf)
    latest = text.where(F.col("old_id") % 3 == 0).select("old_id")
    packed = materialize(tables.compress_text(text, "old", latest), "packed")
    is_packed = F.col("old_flags") == ft.COMPRESSED_FLAG
    unpacked = ft.inflate(F.when(is_packed, F.col("old_text")))
    plain = F.coalesce(unpacked, F.col("old_text").cast("string"))
    return packed.select(
        "old_id", "old_flags", fc.byte_length(plain).alias("n_bytes"), F.md5(plain).alias("digest")
    )


# --- joins ------------------------------------------------------------------------------------------------------


@query
def article_lookup(spark: SparkSession, sf: str) -> DataFrame:
    made = _history_tables(spark, sf)
    return corpus.article_lookup(made["page"], made["revision"], made["text"])


@query
def resolve_namespace(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_pages(spark, sf).select("page_id", "full_title", "page_namespace", "page_title")


def _renumbered(spark: SparkSession, sf: str):
    revs = seeds.revs(spark, sf)
    return ids.renumber(titles.page_headers(revs), revs)


@query
def renumber(spark: SparkSession, sf: str) -> DataFrame:
    pages, revisions = _renumbered(spark, sf)
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("new_page_id").alias("new_id")
                        ).unionByName(revisions.select(F.lit("revision").alias("kind"), F.col("rev_id").alias("id"),
                                                       F.col("new_rev_id").alias("new_id")))


@query
def remap_ids(spark: SparkSession, sf: str) -> DataFrame:
    pages, revisions = _renumbered(spark, sf)
    facts = _facts(spark, sf).select("page_id", "rev_id", "parent_id", "rev_timestamp", "digest")
    return ids.remap_ids(facts, pages, revisions)


# --- aggregates and windows -------------------------------------------------------------------------------------


@query
def conversion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.conversion_counts(_facts(spark, sf))


@query
def page_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rv.page_rollup(_facts(spark, sf))


@query
def count_main_ns(spark: SparkSession, sf: str) -> DataFrame:
    return titles.count_main_ns(_doc_pages(spark, sf))


@query
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.category_counts(seeds.docs(spark, sf))


@query
def current_revision(spark: SparkSession, sf: str) -> DataFrame:
    return rv.current_revision(seeds.revs(spark, sf)).select(
        "page_id", "title", "rev_id", "parent_id", "rev_timestamp", "sha1", "model", "format", "text"
    )


@query
def dedup_titles(spark: SparkSession, sf: str) -> DataFrame:
    return titles.dedup_titles(_doc_pages(spark, sf)).select("page_id", "full_title")


@query
def report_duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return titles.report_duplicate_titles(_doc_pages(spark, sf)).select("page_id", "full_title")


@query
def dedup_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rv.dedup_texts(_facts(spark, sf)).select("page_id", "rev_id", "rev_text_id")


@query
def latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    return rv.latest_revision(_facts(spark, sf))


@query
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ids.batch_ids(_doc_pages(spark, sf))


@query
def order_main_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ids.order_main_ids(_doc_pages(spark, sf))


@query
def corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_rows(seeds.docs(spark, sf))


# --- whole conversions ------------------------------------------------------------------------------------------


KEYS = {"page": "page_id", "revision": "rev_id", "text": "old_id", "recentchanges": "rc_id"}


def _digests(made: dict[str, DataFrame], names: tuple[str, ...] = ("page", "revision", "text")) -> DataFrame:
    """(table_name, id, digest): every row of every table, its values in one digest (page_random, a double, left out)."""
    parts = []
    for name in names:
        columns = [c for c in made[name].columns if c != "page_random"]
        values = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
        parts.append(made[name].select(F.lit(name).alias("table_name"), F.col(KEYS[name]).alias("id"), F.md5(values).alias("digest")))
    return reduce(DataFrame.unionByName, parts)


def _repeated_dump(spark: SparkSession, sf: str) -> list[str]:
    """A dump that was restarted: of every three pages, one comes again as it was and one with other revision ids."""
    path = scratch_path(spark, "dump")
    revs, ns = seeds.revs(spark, sf), seeds.nslist(spark)
    seeds.write_dump(revs, ns, f"{path}/1")
    moved = F.when(F.col("page_id") % 3 == 1, F.col("rev_id") + 10_000_000).otherwise(F.col("rev_id"))
    seeds.write_dump(revs.where(F.col("page_id") % 3 < 2).withColumn("rev_id", moved), ns, f"{path}/2")
    return [*seeds.dump_files(f"{path}/1"), f"{path}/2/pages"]


@query
def convert_dump(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(convert.convert_dump(spark, _revs_dump(spark, sf)))


@query
def convert_history(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(convert.convert_history(spark, _revs_dump(spark, sf), renumber=True))


@query
def convert_history_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts and repeated titles through the history reader."""
    return _digests(convert.convert_history(spark, _docs_dump(spark, sf)))


@query
def convert_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(convert.convert_dump(spark, _repeated_dump(spark, sf)))


@query
def convert_repeated_renumbered(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(convert.convert_history(spark, _repeated_dump(spark, sf), renumber=True))


@query
def convert_options(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen namespaces, compression of all but the latest texts, and timestamps as they are."""
    made = convert.convert_dump(spark, _docs_dump(spark, sf), namespaces=KEEP_NAMESPACES, compress="old", raw_timestamps=True)
    text = materialize(made["text"], "packed")
    packed = F.col("old_flags") == ft.COMPRESSED_FLAG
    plain = F.coalesce(ft.inflate(F.when(packed, F.col("old_text"))), F.col("old_text").cast("string"))
    return _digests(made | {"text": text.select("old_id", plain.alias("old_text"), "old_flags")})


@query
def convert_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """What is left out, beside what is kept: together all page elements of the dump."""
    made = convert.convert_dump(spark, _repeated_dump(spark, sf), namespaces=KEEP_NAMESPACES)
    kept = made["page"].select(F.lit("kept").alias("reason"), "page_id")
    return kept.unionByName(made["rejected"].select("reason", "page_id"))


CURRENT_TABLES = ("page", "revision", "text", "recentchanges")


@query
def convert_current(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(convert.convert_current(spark, _docs_dump(spark, sf)), CURRENT_TABLES)


@query
def create_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    convert.create_corpus(spark, _docs_dump(spark, sf), path)
    return spark.read.schema("ordinal BIGINT, article STRING, category STRING").parquet(path)


@query
def main_articles(spark: SparkSession, sf: str) -> DataFrame:
    found = convert.main_articles(spark, _docs_dump(spark, sf))
    return found.withColumn("categories", F.array_join("categories", "|"))


# --- streaming and user code ------------------------------------------------------------------------------------


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs_dump(spark, sf, "bzip2")
    out = scratch_path(spark, "stream")
    pages = ingest.stream_pages(spark, files[1], 4)
    ingest.stream_ingest(pages, out, f"{out}-checkpoint").awaitTermination()
    made = {t: spark.read.parquet(f"{out}/{t}").drop("batch") for t in CURRENT_TABLES}
    return _digests(made, CURRENT_TABLES)


@query
def stream_dedup_titles(spark: SparkSession, sf: str) -> DataFrame:
    """One file a batch; the row of the latest batch is a title's answer."""
    files = _docs_dump(spark, sf)
    out = scratch_path(spark, "titles")
    pages = ingest.stream_titles(spark, files[1], 1)
    writer = ingest.stream_dedup_titles(pages).writeStream.outputMode("update").foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    )
    writer.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("full_title").agg(F.max_by("page_id", "batch").alias("page_id"))


def _link_count(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"page_id": frame["page_id"], "n_links": frame["text"].str.count(r"\[\[").astype("int64")})


@query
def map_user_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = seeds.docs(spark, sf).select("page_id", "text")
    return map_pages(pages, _link_count, "page_id BIGINT, n_links BIGINT")


QUERIES["map_pages"] = QUERIES.pop("map_user_pages")
