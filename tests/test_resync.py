"""A page that never closes costs itself only: the scan resynchronises at the next page."""

import pytest
from pyspark.sql import functions as F

from dumptables.plans import convert
from dumptables.sources import dump, history
from tests import dump_fixture as fx

PAGE = """<page>
    <title>Page {i}</title>
    <ns>0</ns>
    <id>{i}</id>
    <revision>
      <id>{rev}</id>
      <timestamp>2005-08-31T01:02:03Z</timestamp>
      <contributor><username>Ann</username><id>7</id></contributor>
      <text xml:space="preserve">text of page {i}, with &lt;page&gt; in it.</text>
      <sha1>s{i}</sha1>
    </revision>
  </page>
"""
CUT_IDS = {3, 13, 23, 33, 34}


def page(i):
    text = PAGE.format(i=i, rev=10 * i)
    if i in CUT_IDS:  # cut inside the text, or right after the header, as a broken write leaves it
        return text[:text.index("text of") + 7] if i % 2 else text[:text.index("<revision>")]
    return text


@pytest.fixture(params=[None, "1500"])
def path(request, tmp_path, conf):
    if request.param:
        conf("spark.sql.files.maxPartitionBytes", request.param)  # splits fall inside pages
    file = tmp_path / "cut.xml"
    file.write_text(fx.HEAD + "".join("  " + page(i) for i in range(1, 41)) + "</mediawiki>\n", encoding="utf-8")
    return str(file)


def test_scan_keeps_every_closed_page(spark, path):
    ok, bad = dump.quarantine_malformed(dump.scan_dump(spark, path))
    assert sorted(r.id for r in ok.collect()) == sorted(set(range(1, 41)) - CUT_IDS)
    cut = bad.collect()
    assert sorted((r.id, r.title) for r in cut) == sorted((i, f"Page {i}") for i in CUT_IDS)
    assert all(r._corrupt.startswith("<page>") and f"<id>{r.id}</id>" in r._corrupt and not r.revision for r in cut)
    assert ok.count() + bad.count() == 40


@pytest.mark.parametrize("how", [convert.convert_dump, convert.convert_current])
def test_conversions_lose_only_the_cut_pages(spark, path, how):
    made = how(spark, path)
    kept = sorted(r.page_id for r in made["page"].collect())
    assert kept == sorted(set(range(1, 41)) - CUT_IDS)
    rejected = made["rejected"].collect()
    assert sorted(r.page_id for r in rejected) == sorted(CUT_IDS)
    assert {r.reason for r in rejected} == {convert.MALFORMED_PAGE}
    assert len(kept) + len(rejected) == 40
    texts = made["text"].collect()
    assert len(texts) == len(kept) and all("&lt;" not in r.old_text and "<page>" in r.old_text for r in texts)


def history_page(i, revisions, cut_at=None):
    """A page of a full history; the revision at ``cut_at`` never closes, and neither does its page."""
    text = f"<page>\n    <title>Page {i}</title>\n    <ns>0</ns>\n    <id>{i}</id>\n"
    for n in range(revisions):
        rev = f"    <revision>\n      <id>{100 * i + n}</id>\n      <timestamp>2005-08-31T01:02:03Z</timestamp>\n" \
              f"      <text xml:space=\"preserve\">revision {n} of page {i}</text>\n    </revision>\n"
        if n == cut_at:
            return text + rev[:rev.index("revision " + str(n))]
        text += rev
    return text + "  </page>\n"


@pytest.mark.parametrize("split", [None, "700"])
def test_history_resynchronises(spark, tmp_path, conf, split):
    if split:
        conf("spark.sql.files.maxPartitionBytes", split)
    pages = [history_page(1, 2), history_page(2, 3, cut_at=1), history_page(3, 2), history_page(4, 1, cut_at=0),
             history_page(5, 3), "<page>\n    <title>Page 6</title>\n    <ns>0</ns>\n    <id>6</id>\n  </page>\n"]
    file = tmp_path / "history.xml"
    file.write_text(fx.HEAD + "".join("  " + p for p in pages) + "</mediawiki>\n", encoding="utf-8")
    made = convert.convert_history(spark, str(file))
    assert sorted(r.page_id for r in made["page"].collect()) == [1, 2, 3, 5, 6]
    assert sorted(r.rev_id for r in made["revision"].collect()) == [100, 101, 200, 300, 301, 500, 501, 502]
    bad = sorted((r.reason, r.page_id, r.rev_id) for r in made["rejected"].where(F.col("reason") == convert.MALFORMED_REVISION).collect())
    assert bad == [(convert.MALFORMED_REVISION, 2, 201), (convert.MALFORMED_REVISION, 4, 400)]
    facts = history.scan_history(spark, str(file)).where("malformed IS NOT NULL").collect()
    assert sorted((r.page_id, r.title) for r in facts) == [(2, "Page 2"), (4, "Page 4")]


def test_namespaces_are_chosen_before_the_parse(spark, tmp_path):
    path = fx.write(tmp_path / "d.xml", cut_off=True)
    chosen = dump.scan_dump(spark, path, namespaces=[0, 3])
    every = dump.scan_dump(spark, path)
    key = ["id", "title", "ns", "_corrupt"]
    want = every.where("_corrupt IS NOT NULL OR ns IS NULL OR ns IN (0, 3)")
    assert sorted(map(tuple, chosen.select(key).collect()), key=repr) == sorted(map(tuple, want.select(key).collect()), key=repr)
    assert chosen.count() < every.count()
    text = chosen._jdf.queryExecution().executedPlan().toString()
    parse, choice = text.index("from_xml("), text.index("regexp_extract(xml")
    assert choice > parse  # the filter stands below the parse in the printed tree: it runs first
