"""What the plans must look like to hold at scale."""

import re

import pytest

from pyspark.sql import functions as F

from dumptables.functions import columns as fc
from dumptables.operators import corpus, ids, tables, titles
from dumptables.operators import revisions as rv
from dumptables.plans import seeds
from dumptables.sources import dump, history
from tests import dump_fixture as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def revs(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    return seeds.revs(spark, SF)


def test_costly_expressions_are_made_once(spark, revs):
    docs = seeds.docs(spark, SF)
    assert plan(corpus.corpus_rows(docs)).count("regexp_extract_all(") == 1
    assert plan(corpus.category_counts(docs)).count("regexp_extract_all(") == 1
    kept = fc.text_lines(fc.drop_tag_blocks("text", "T"))
    assert plan(docs.select(F.posexplode(kept))).count("regexp_replace(") == 1


def test_windows_run_over_bounded_groups(revs):
    """The running maximum is taken per run; only one row per run is grouped by page."""
    text = plan(rv.latest_revision(rv.revision_facts(revs)))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(shuffles) == 2
    first = [s for s in shuffles if "run#" in s]
    assert len(first) == 1
    below_page_shuffle = text[text.index("Exchange hashpartitioning(page_id"):]
    assert "SortAggregate(key=[page_id" in below_page_shuffle.split("Window", 1)[0]


def test_salt_is_part_of_the_shuffle_key(revs):
    text = plan(rv.dedup_texts(rv.revision_facts(revs)))
    join = next(line for line in text.splitlines() if "SortMergeJoin" in line)
    assert re.search(r"\[page_id#\d+L, digest#\d+, _salt#\d+\], \[page_id#\d+L, digest#\d+, _salt#\d+\]", join)
    assert len(re.findall(r"Exchange hashpartitioning\(page_id#\d+L, digest#\d+, _salt#\d+", text)) == 2


def test_both_sides_of_a_lookup_share_one_shuffle(revs, conf):
    conf("spark.sql.adaptive.enabled", "false")
    text = plan(rv.dedup_texts(rv.revision_facts(revs)))
    assert text.count("ReusedExchange") == 1 and text.count("FileScan") == 2


def test_titles_are_reduced_before_the_shuffle(revs):
    pages = titles.page_headers(revs).withColumnRenamed("title", "full_title")
    text = plan(titles.dedup_titles(pages))
    assert "Window" not in text
    assert "partial_min_by" in text


def test_unread_columns_stay_in_the_file(spark):
    facts = rv.revision_facts(seeds.revs(spark, SF))
    schema = re.findall(r"ReadSchema: (\S+)", plan(titles.page_headers(facts.drop("digest"))))
    assert all("props" not in s for s in schema)
    schema = re.findall(r"ReadSchema: (\S+)", plan(corpus.category_counts(seeds.docs(spark, SF))))
    assert schema == ["struct<doc_id:bigint,text:string,lang:string,source:string>"]


def test_a_page_is_parsed_once(spark, tmp_path):
    path = fx.write(tmp_path / "d.xml")
    good, bad = dump.quarantine_malformed(dump.scan_dump(spark, path))
    for df in (good, bad, dump.explode_revisions(good), rv.revision_facts(dump.explode_revisions(good))):
        assert plan(df).count("from_xml(") == 1
    headers = dump.scan_headers(spark, path)
    assert "revision" not in plan(headers) and headers.where("id = 17").count() == 1
    assert plan(history.history_facts(history.stage_history(spark, path))).count("from_xml(") == 0


def test_no_python_outside_of_compression(spark, revs):
    facts = rv.revision_facts(revs)
    headers = titles.resolve_namespace(titles.page_headers(facts), seeds.nslist(spark))
    for df in (tables.build_page(headers, facts), tables.build_revision(facts), tables.build_text(revs),
               titles.dedup_titles(headers), rv.current_revision(revs), tables.conversion_counts(facts)):
        assert "Python" not in plan(df) and "ArrowEval" not in plan(df)


def test_no_single_task_window_over_rows(spark):
    """The only unpartitioned window has one row per partition."""
    text = plan(ids.dense_index(spark.range(1000), ["id"], ["id"]))
    single = text[text.index("SinglePartition"):]
    assert "HashAggregate(keys=[_part" in single.split("FileScan")[0]


def test_no_cartesian_products(spark, revs):
    facts = rv.revision_facts(revs)
    headers = titles.resolve_namespace(titles.page_headers(facts), seeds.nslist(spark))
    kept = titles.filter_namespaces(headers, seeds.nslist(spark), ["0", "talk"])
    for df in (tables.build_page(headers, facts), tables.build_revision(facts), kept):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
