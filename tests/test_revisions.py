"""Revision rules against plain loops, with hot keys, small runs and no broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from dumptables.operators import ids, titles
from dumptables.operators import revisions as rv
from dumptables.operators import tables

SCHEMA = ("page_id BIGINT, page_seq BIGINT, rev_seq BIGINT, title STRING, rev_id BIGINT, parent_id BIGINT, "
          "rev_timestamp STRING, text STRING")


def sample(seed, n=600, pages=12):
    """A third of all rows belong to page 0, and a third of those hold one text."""
    rng = random.Random(seed)
    rows, seqs = [], rng.sample(range(n * 3), n)
    for i in range(n):
        page = 0 if rng.random() < 0.34 else rng.randrange(1, pages)
        text = rng.choice([None, "", "same", "same", f"t{rng.randrange(9)}", "#Redirect [[é]]"])
        rows.append((page, pages - page, seqs[i], f"Page {page // 2}", i + 1, None if i % 3 == 0 else max(1, i - 5),
                     f"20{rng.randrange(10, 40)}-01-01T00:00:00Z", text))
    return rows


def walk(rows):
    """Latest revision by the rule, one revision after the other."""
    out = {}
    for page, _, _, _, rev, _, ts, text in sorted(rows, key=lambda r: r[2]):
        state = out.setdefault(page, {"ts": None, "id": None, "len": 0, "redir": 0})
        if state["ts"] is None or state["ts"] < ts:
            state["ts"], state["id"] = ts, rev
            if text:
                state["len"] = len(text.encode())
                state["redir"] = int(text[:9].upper() == "#REDIRECT" and "[[" in text)
    return {p: (s["id"], s["ts"], s["len"], s["redir"]) for p, s in out.items()}


def text_ids(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[2]):
        first.setdefault((r[0], r[7] or ""), r[4])
    return {r[4]: first[(r[0], r[7] or "")] for r in rows}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bits", [1, 4, 16])
def test_latest_revision(spark, seed, bits):
    rows = sample(seed)
    facts = rv.revision_facts(spark.createDataFrame(rows, SCHEMA))
    got = {r.page_id: tuple(r)[1:] for r in rv.latest_revision(facts, bits).collect()}
    assert got == walk(rows)


@pytest.mark.parametrize("partitions", [1, 4, 32])
@pytest.mark.parametrize("hot", [1, 20, 10**6])
def test_dedup_texts(spark, conf, partitions, hot):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = sample(5)
    facts = rv.revision_facts(spark.createDataFrame(rows, SCHEMA).repartition(partitions))
    got = {r.rev_id: r.rev_text_id for r in rv.dedup_texts(facts, hot_rows=hot).collect()}
    assert got == text_ids(rows)


def test_page_rollup_and_counts(spark):
    rows = sample(6)
    facts = rv.revision_facts(spark.createDataFrame(rows, SCHEMA))
    distinct = {}
    for r in rows:
        distinct.setdefault(r[0], set()).add(r[7] or "")
    got = {r.page_id: (r.n_texts, r.is_new) for r in rv.page_rollup(facts).collect()}
    assert got == {p: (len(t), int(len(t) == 1)) for p, t in distinct.items()}
    counts = {r["item"]: r["n"] for r in tables.conversion_counts(facts).collect()}
    assert counts == {"pages": len(distinct), "revisions": len(rows), "texts": sum(map(len, distinct.values()))}


def test_text_table_holds_every_text_id(spark):
    rows = sample(7)
    revs = spark.createDataFrame(rows, SCHEMA)
    text = {r.old_id: r.old_text for r in tables.build_text(revs).collect()}
    by_id = {r[4]: r[7] or "" for r in rows}
    assert text == {i: by_id[i] for i in set(text_ids(rows).values())}


def test_current_revision_takes_each_field_from_its_last_value(spark):
    rows = [(1, 1, 0, "A", 10, None, "2020", "s1", "wikitext", None, "old"),
            (1, 1, 1, "A", 11, 10, "2021", None, None, "f", None)]
    df = spark.createDataFrame(rows, "page_id BIGINT, page_seq BIGINT, rev_seq BIGINT, title STRING, rev_id BIGINT, "
                                     "parent_id BIGINT, rev_timestamp STRING, sha1 STRING, model STRING, "
                                     "format STRING, text STRING")
    r = rv.current_revision(df).first()
    assert (r.rev_id, r.parent_id, r.rev_timestamp, r.sha1, r.model, r.format, r.text) == (
        11, 10, "2021", "s1", "wikitext", "f", "old")


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_dense_index(spark, partitions):
    df = spark.range(5000).select(((F.col("id") * 7919) % 100003).alias("k")).repartition(partitions)
    rows = ids.dense_index(df, ["k"], ["k"]).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.idx)] == sorted(r.k for r in rows)
    assert sorted(r.idx for r in rows) == list(range(5000))


def test_dense_index_of_nothing(spark):
    assert ids.dense_index(spark.range(0), ["id"], ["id"]).collect() == []


@pytest.mark.parametrize("hot", [1, 10**6])
def test_renumber_and_remap(spark, conf, hot):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = sample(8)
    revs = spark.createDataFrame(rows, SCHEMA)
    pages, revisions = ids.renumber(titles.page_headers(revs), revs)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    new_rev = {r[4]: i + 1 for i, r in enumerate(ordered)}
    new_page = {p: i + 1 for i, p in enumerate(dict.fromkeys(r[0] for r in ordered))}
    assert {r.rev_id: r.new_rev_id for r in revisions.collect()} == new_rev
    assert {r.page_id: r.new_page_id for r in pages.collect()} == new_page
    got = ids.remap_ids(revs.drop("text"), pages, revisions, hot_rows=hot)
    assert sorted((r.rev_id, r.page_id, r.parent_id) for r in got.collect()) == sorted(
        (new_rev[r[4]], new_page[r[0]], new_rev.get(r[5], 0)) for r in rows)


def test_batches(spark):
    pages = spark.range(2500).select(F.col("id").alias("page_id"), (F.col("id") % 2).cast("int").alias("page_namespace"))
    sizes = {r.batch: r["count"] for r in ids.batch_ids(pages).groupBy("batch").count().collect()}
    assert sizes == {0: 1000, 1: 250}
    listed = [r.page_id for r in ids.order_main_ids(pages).collect()]
    assert listed == list(range(0, 2500, 2))


def test_first_title_wins_with_a_hot_title(spark):
    rows = [(i, (i * 7) % 1009, "Hot" if i % 3 == 0 else f"T{i % 50}") for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, page_seq BIGINT, full_title STRING")
    first = {}
    for page, seq, title in sorted(rows, key=lambda r: r[1]):
        first.setdefault(title, page)
    assert {r.full_title: r.page_id for r in titles.dedup_titles(pages).collect()} == first
    dropped = {r.page_id for r in titles.report_duplicate_titles(pages).collect()}
    assert dropped == {r[0] for r in rows} - set(first.values())
