"""What must hold between the tables of any input, and for any partitioning of it."""

import pytest
from pyspark.sql import functions as F

from dumptables.operators import tables
from dumptables.operators import revisions as rv
from dumptables.plans import convert, seeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    out = convert.history_tables(seeds.revs(spark, SF), seeds.nslist(spark))
    return {name: df.cache() for name, df in out.items()}


def test_every_text_id_exists_once(made):
    ids = made["revision"].select(F.col("rev_text_id").alias("old_id")).distinct()
    assert ids.exceptAll(made["text"].select("old_id")).count() == 0
    assert made["text"].select("old_id").exceptAll(ids).count() == 0


def test_texts_of_a_page_differ(made):
    owner = made["revision"].select("rev_page", F.col("rev_text_id").alias("old_id")).distinct()
    texts = made["text"].join(owner, "old_id")
    assert texts.groupBy("rev_page", "old_text").count().where("count > 1").count() == 0


def test_latest_revision_belongs_to_its_page(made):
    joined = made["page"].join(made["revision"], F.col("page_latest") == F.col("rev_id"))
    assert joined.count() == made["page"].count()
    assert joined.where("rev_page <> page_id OR page_touched <> rev_timestamp").count() == 0


def test_renumbering_changes_ids_only(spark, made):
    new = convert.history_tables(seeds.revs(spark, SF), seeds.nslist(spark), renumber=True)
    new = {name: df.cache() for name, df in new.items()}
    n_pages, n_revisions = made["page"].count(), made["revision"].count()
    assert sorted(r.page_id for r in new["page"].collect()) == list(range(1, n_pages + 1))
    assert sorted(r.rev_id for r in new["revision"].collect()) == list(range(1, n_revisions + 1))
    rest = ["page_namespace", "page_title", "page_is_redirect", "page_is_new", "page_touched", "page_len"]
    assert new["page"].select(rest).exceptAll(made["page"].select(rest)).count() == 0
    texts = [sorted(r.old_text for r in t["text"].collect()) for t in (new, made)]
    assert texts[0] == texts[1]
    assert new["page"].join(new["revision"], F.col("page_latest") == F.col("rev_id")).where(
        "rev_page = page_id").count() == n_pages


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_partitioning_does_not_matter(spark, partitions):
    revs = seeds.revs(spark, SF)
    spread = revs.repartition(partitions, F.xxhash64("rev_id"))
    for build in (rv.latest_revision, rv.dedup_texts, tables.conversion_counts):
        ours, theirs = build(rv.revision_facts(spread)), build(rv.revision_facts(revs))
        assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0
    assert tables.build_text(spread).exceptAll(tables.build_text(revs)).count() == 0
    assert rv.current_revision(spread).exceptAll(rv.current_revision(revs)).count() == 0
