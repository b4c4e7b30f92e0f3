import bz2
import random

import pytest
from pyspark.sql import functions as F

from dumptables.operators import titles
from dumptables.plans import convert, seeds
from dumptables.sources import dump, history
from tests import dump_fixture as fx

GOOD_IDS = [10, 11, 12, 13, 14, 15, 17]


@pytest.fixture
def path(tmp_path):
    return fx.write(tmp_path / "dump.xml", cut_off=True)


def good(spark, path):
    return dump.quarantine_malformed(dump.scan_dump(spark, path))[0]


def test_scan_keeps_good_pages_around_bad_ones(spark, path):
    ok, bad = dump.quarantine_malformed(dump.scan_dump(spark, path))
    assert [r.id for r in ok.orderBy("page_seq").collect()] == GOOD_IDS
    broken = sorted(r._corrupt for r in bad.collect())
    assert len(broken) == 2
    assert any("x16" in b for b in broken) and any("never clo" in b for b in broken)


def test_text_is_exact(spark, path):
    revs = dump.explode_revisions(good(spark, path))
    texts = {r.rev_id: r.text for r in revs.collect()}
    assert texts[100].replace("  ", " ") == texts[102] == fx.FIRST_TEXT
    assert texts[101] == ""
    assert texts[140] == "null"


def test_revisions(spark, path):
    rows = {r.rev_id: r for r in dump.explode_revisions(good(spark, path)).collect()}
    assert rows[100].minor and not rows[101].minor
    assert (rows[101].ip, rows[101].username, rows[101].contributor_id) == ("10.0.0.1", None, None)
    assert (rows[100].username, rows[100].contributor_id, rows[100].comment) == ("Ann", 7, "first & best")
    assert [rows[i].rev_seq for i in (100, 101, 102)] == [0, 1, 2]
    assert rows[None].page_id == 15
    assert rows[110].redirect_title == "Main page"


ODD = """<mediawiki><page>
 <title>A &quot;q&quot; &amp; B</title><ns>0</ns><id>1</id><restrictions>a</restrictions><restrictions>b</restrictions>
 <revision><id>11</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor deleted="deleted" />
  <comment deleted="deleted" /><origin>11</origin><model>wikitext</model><format>text/x-wiki</format>
  <text bytes="12" sha1="abc" xml:space="preserve">&lt;page&gt; &lt;/revision&gt; &#233;&#x1F600;]]&gt;</text></revision>
 <revision><id>12</id><contributor><ip>::1</ip></contributor><minor/><text bytes="0" deleted="deleted" /></revision>
 <upload><timestamp>x</timestamp><contributor><username>u</username><id>5</id></contributor></upload>
 <discussionthreadinginfo><id>99</id></discussionthreadinginfo>
</page><page><title>Next</title><id>2</id><revision><id>21</id><text>  </text></revision></page></mediawiki>
"""


def test_elements_outside_the_schema(spark, tmp_path):
    file = tmp_path / "odd.xml"
    file.write_text(ODD, encoding="utf-8")
    ok, bad = dump.quarantine_malformed(dump.scan_dump(spark, str(file)))
    rows = {r.rev_id: r for r in dump.explode_revisions(ok).collect()}
    assert sorted(rows) == [11, 12, 21] and bad.count() == 0
    assert (rows[11].title, rows[11].text, rows[11].username, rows[11].restrictions) == (
        'A "q" & B', "<page> </revision> é😀]]>", None, "b")
    assert (rows[12].text, rows[12].ip, rows[12].minor) == ("", "::1", True)
    assert rows[21].text == "  "
    facts = {r.rev_id: r for r in history.scan_history(spark, str(file)).collect()}
    assert {i: (r.page_id, r.ip, r.minor) for i, r in facts.items()} == {
        11: (1, None, False), 12: (1, "::1", True), 21: (2, None, False)}
    assert (facts[11].text_bytes, facts[12].text_bytes, facts[12].digest) == (28, None, "")


def test_one_bz2_file_is_split(spark, tmp_path, conf):
    rng = random.Random(1)
    pages = "".join(
        f"<page><title>P{i}</title><id>{i}</id>" + "".join(
            f"<revision><id>{i * 10 + j}</id><text>{rng.getrandbits(8000):x}</text></revision>" for j in range(3)
        ) + "</page>\n" for i in range(1, 600))
    file = tmp_path / "big.xml.bz2"
    file.write_bytes(bz2.compress(f"<mediawiki>{pages}</mediawiki>".encode()))
    conf("spark.sql.files.maxPartitionBytes", "300KB")
    scanned = dump.scan_dump(spark, str(file))
    assert scanned.rdd.getNumPartitions() > 2
    assert scanned.select("page_seq.block").distinct().count() > 1
    assert [r.id for r in scanned.orderBy("page_seq").select("id").collect()] == list(range(1, 600))
    facts = history.scan_history(spark, str(file))
    assert {(r.page_id, r.rev_id) for r in facts.collect()} == {(i, i * 10 + j) for i in range(1, 600) for j in range(3)}
    listed = [r.rev_id for r in facts.orderBy("page_seq", "rev_seq").select("rev_id").collect()]
    assert listed == sorted(listed)


def test_a_revision_without_id_is_set_aside(spark, tmp_path):
    file = tmp_path / "d.xml"
    file.write_text("<mediawiki><page><title>A</title><id>1</id><revision><text>lost</text></revision><revision><id>5"
                    "</id><text>kept</text></revision></page><page><title>B</title><id>2</id></page></mediawiki>")
    ok, bad = dump.quarantine_revisions(dump.explode_revisions(good(spark, str(file))))
    assert sorted((r.page_id, r.rev_id, r.text) for r in ok.collect() if r.rev_id) == [(1, 5, "kept")]
    assert ok.count() == 2
    assert [r.text for r in bad.collect()] == ["lost"]


def test_namespaces(spark, path):
    rows = dump.scan_namespaces(spark, path).orderBy("ns_pos").collect()
    assert [(r.ns_pos, r.ns_id, r.ns_name) for r in rows] == [
        (0, -1, "Special"), (1, 0, None), (2, 1, "Talk"), (3, 3, "User talk")]


def test_bz2_gives_the_same_pages(spark, path, tmp_path):
    packed = tmp_path / "dump.xml.bz2"
    packed.write_bytes(bz2.compress(open(path, "rb").read()))
    plain = good(spark, path).drop("page_seq")
    assert plain.exceptAll(good(spark, str(packed)).drop("page_seq")).count() == 0


def test_tag_blocks_are_cut_before_parsing(spark, path):
    rows = dump.scan_dump(spark, path, drop_blocks=["DiscussionThreading"])
    assert dump.quarantine_malformed(rows)[0].count() == len(GOOD_IDS)


def test_titles_and_namespaces(spark, path):
    headers = dump.dump_headers(good(spark, path))
    ns = dump.scan_namespaces(spark, path)
    resolved = titles.resolve_namespace(headers, ns)
    rows = {r.page_id: (r.page_namespace, r.page_title) for r in resolved.collect()}
    assert rows == {
        10: (0, "Main_page"), 11: (3, "Bob_Smith"), 12: (0, "Main_page"), 13: (0, "Other:Thing"),
        14: (0, "talk:Lower"), 15: (1, "Empty"), 17: (1, "After"),
    }
    assert [r.page_id for r in titles.report_duplicate_titles(resolved).collect()] == [12]
    assert sorted(r.page_id for r in titles.dedup_titles(resolved).collect()) == [10, 11, 13, 14, 15, 17]
    chosen = titles.filter_namespaces(resolved, ns, ["1", "USER_talk", "none", "99"])
    assert sorted(r.page_id for r in chosen.collect()) == [11, 15, 17]
    assert sorted(r.token for r in titles.unmatched_namespaces(ns, ["1", "none", "99"]).collect()) == ["99", "none"]


def history_result(made):
    page = {r.page_id: r for r in made["page"].collect()}
    revision = {r.rev_id: r for r in made["revision"].collect()}
    text = {r.old_id: r.old_text for r in made["text"].collect()}
    return page, revision, text


@pytest.mark.parametrize("how", ["dump", "history"])
def test_history_tables(spark, path, how):
    made = (convert.convert_dump if how == "dump" else convert.convert_history)(spark, path)
    page, revision, text = history_result(made)
    assert sorted(page) == [10, 11, 13, 14, 15, 17]
    main = page[10]
    # 101 and 102 share a timestamp: the first stays the latest; it is empty, so length and flag stay those of 100
    assert (main.page_latest, main.page_touched, main.page_restrictions) == (101, "20060101000000", "edit=sysop")
    assert main.page_len == len([t for t in text.items() if t[0] == 100][0][1].encode())
    assert (page[11].page_is_redirect, page[13].page_is_redirect) == (1, 0)
    assert [page[i].page_is_new for i in (10, 11, 15, 17)] == [0, 1, 0, 0]
    assert (page[15].page_latest, page[15].page_len, page[15].page_touched) == (0, 0, "")
    assert page[17].page_latest == 170
    assert sorted(revision) == [100, 101, 102, 110, 130, 140, 170, 171]
    assert revision[101].rev_user_text == "10.0.0.1" and revision[101].rev_user == 0
    assert revision[101].rev_parent_id == 100 and revision[100].rev_parent_id == 0
    assert revision[100].rev_minor_edit == 1 and revision[100].rev_content_model == "wikitext"
    assert {r.rev_text_id for r in revision.values()} == set(text)
    assert text[101] == ""


def test_history_options(spark, path):
    made = convert.convert_dump(spark, path, namespaces=["talk"], renumber=True, compress="full")
    page, revision, text = history_result(made)
    assert sorted((r.page_id, r.page_title) for r in page.values()) == [(1, "Empty"), (2, "After")]
    assert sorted((r.rev_id, r.rev_page, r.rev_parent_id) for r in revision.values()) == [(1, 2, 0), (2, 2, 1)]
    assert page[2].page_latest == 1
    assert text[1] == bytearray(b"later text")
    assert "text" not in convert.convert_dump(spark, path, with_text=False)


def test_one_bad_revision_does_not_take_its_page_along(spark, tmp_path):
    file = tmp_path / "d.xml"
    file.write_text("<mediawiki><page><title>A</title><id>1</id><revision><id>5</id><text>kept</text></revision>"
                    "<revision><id>x6</id><text>bad</text></revision><revision><id>7</id><text>kept too</text>"
                    "</revision></page></mediawiki>")
    page, revision, text = history_result(convert.convert_history(spark, str(file)))
    assert sorted(page) == [1] and sorted(revision) == sorted(text) == [5, 7]
    bad = history.scan_history(spark, str(file)).where("malformed IS NOT NULL").collect()
    assert [(r.page_id, "x6" in r.malformed) for r in bad] == [(1, True)]


def test_staged_rows_part_in_good_and_bad(spark, path):
    staged = convert.stage_dump(spark, path)
    assert {r.page_id for r in convert.good_revisions(staged).select("page_id").collect()} == set(GOOD_IDS)
    bad = [r._corrupt for r in convert.bad_pages(staged).collect()]
    assert len(bad) == 2 and any("x16" in b for b in bad)


def test_current_tables(spark, path):
    made = convert.convert_current(spark, path)
    page = {r.page_id: r for r in made["page"].collect()}
    assert sorted(page) == [10, 12, 13, 14, 17]  # no redirect, no page without revisions
    assert (page[10].page_latest, page[10].page_len) == (102, len(fx.FIRST_TEXT))
    changes = {r.rc_id: r for r in made["recentchanges"].collect()}
    assert changes[10].rc_timestamp == "20060101000000" and changes[10].rc_new_len == len(fx.FIRST_TEXT)
    assert {r.old_id: r.old_text for r in made["text"].collect()}[17] == "earlier text, although it stands later"


def test_splits_and_files_do_not_matter(spark, tmp_path, conf):
    """One file or many, one split or hundreds: same pages and revisions, also where a split cuts a page."""
    revs = spark.range(3000).select(
        (F.col("id") % 7).alias("page_id"), (F.col("id") % 7).alias("page_seq"), F.col("id").alias("rev_seq"),
        F.concat(F.lit("Page "), (F.col("id") % 7).cast("string")).alias("title"), (F.col("id") + 1).alias("rev_id"),
        F.when(F.col("id") >= 7, F.col("id") - 6).alias("parent_id"),
        F.lit("2020-01-01T00:00:00Z").alias("rev_timestamp"), F.lit(1).cast("bigint").alias("contributor_id"),
        F.lit("u").alias("username"), F.lit(None).cast("string").alias("ip"), (F.col("id") % 2 == 0).alias("minor"),
        F.lit("c").alias("comment"), F.lit("wikitext").alias("model"), F.lit("text/x-wiki").alias("format"),
        F.lit("s").alias("sha1"), F.repeat(F.concat(F.lit("line "), F.col("id").cast("string")), 5).alias("text"),
    )
    columns = ["page_id", "title", "rev_id", "parent_id", "minor", "digest", "text_bytes"]
    out = str(tmp_path / "dump")
    conf("spark.sql.shuffle.partitions", "1")
    seeds.write_dump(revs, seeds.nslist(spark), out)
    conf("spark.sql.shuffle.partitions", "4")
    files = seeds.dump_files(out)
    expected = sorted(map(tuple, convert.revision_facts(revs).select(*columns).collect()))
    for size in ("128MB", "11KB"):
        conf("spark.sql.files.maxPartitionBytes", size)
        rows = history.scan_history(spark, files)
        got = rows.where(F.col("rev_id").isNotNull())
        assert sorted(map(tuple, got.select(*columns).collect())) == expected
        ordered = got.where("page_id = 3").orderBy("rev_seq").select("rev_id").collect()
        assert [r.rev_id for r in ordered] == sorted(r.rev_id for r in ordered)
        pages = dump.quarantine_malformed(dump.scan_dump(spark, files))[0]
        flat = convert.revision_facts(dump.explode_revisions(pages))
        assert sorted(map(tuple, flat.select(*columns).collect())) == expected
        assert history.history_texts(history.stage_history(spark, files)).count() == 3000
    assert dump.scan_dump(spark, files).rdd.getNumPartitions() > 20
