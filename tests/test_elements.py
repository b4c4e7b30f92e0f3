"""Page elements that come twice, and what conversions leave out."""

import re

import pytest
from pyspark.sql import functions as F

from dumptables import session
from dumptables.plans import convert
from tests.test_plans import plan

SITE = '<siteinfo><namespaces><namespace key="0" /><namespace key="1">Talk</namespace></namespaces></siteinfo>'


def revision(number, text="t", stamp="2020-01-01T00:00:00Z"):
    return f"<revision><id>{number}</id><timestamp>{stamp}</timestamp><text>{text}</text></revision>"


def page(number, title, *revisions):
    return f"<page><title>{title}</title><id>{number}</id>{''.join(revisions)}</page>\n"


def dump_of(tmp_path, *pages):
    file = tmp_path / "d.xml"
    file.write_text(f"<mediawiki>{SITE}{''.join(pages)}</mediawiki>")
    return str(file)


CONVERSIONS = {"dump": convert.convert_dump, "history": convert.convert_history}


@pytest.mark.parametrize("how", CONVERSIONS)
@pytest.mark.parametrize("renumber", [False, True])
def test_a_repeated_element_goes_with_its_revisions(spark, tmp_path, how, renumber):
    path = dump_of(
        tmp_path, page(1, "A", revision(10, "one")), page(2, "B", revision(20, "b")),
        page(1, "A", revision(11, "two", "2021-01-01T00:00:00Z")), page(1, "A", revision(10, "one")),
        page(2, "Other", revision(21)))
    made = CONVERSIONS[how](spark, path, renumber=renumber)
    pages = sorted((r.page_title, r.page_latest) for r in made["page"].collect())
    assert pages == ([("A", 1), ("B", 2)] if renumber else [("A", 10), ("B", 20)])
    assert sorted(r.rev_id for r in made["revision"].collect()) == ([1, 2] if renumber else [10, 20])
    assert sorted(r.old_text for r in made["text"].collect()) == ["b", "one"]
    assert sorted((r.page_id, r.reason) for r in made["rejected"].collect()) == [(n, convert.REPEATED) for n in (1, 1, 2)]


@pytest.mark.parametrize("how", [*CONVERSIONS, "current"])
def test_everything_is_kept_or_rejected(spark, tmp_path, how):
    path = dump_of(
        tmp_path, page(1, "A", revision(10), "<revision><text>lost</text></revision>"), page("x2", "B", revision(20)),
        page(3, "Talk:C", revision(30)), page(4, "D"), "<page><title>E</title><id>5</id><redirect title='A' />" + revision(50) + "</page>")
    found = sorted((r.reason, r.title, r.rev_id) for r in
                   (convert.convert_current(spark, path) if how == "current" else CONVERSIONS[how](spark, path, namespaces=["0"]))["rejected"].collect())
    reasons = [r for r, _, _ in found]
    assert convert.NO_REVISION_ID in reasons and any(r in (convert.MALFORMED_PAGE, convert.NO_SUCH_PAGE) for r in reasons)
    if how == "current":
        assert {convert.REDIRECT, convert.NO_REVISIONS} <= set(reasons) and len(found) == 4
    else:
        assert (convert.OTHER_NAMESPACE, "Talk:C", None) in found and len(found) == 3


def test_texts_move_once_and_unsorted(spark, tmp_path, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    path = dump_of(tmp_path, page(1, "A", revision(10)))
    lines = plan(convert.convert_dump(spark, path, renumber=True, compress="old")["text"]).splitlines()
    # The scan of the stored texts, and one exchange above it; no sort, aggregate or other join of a text.
    assert not [x for x in lines if re.search(r"Aggregate|SortMergeJoin|Sort \[", x) and re.search(r"\btext#", x)]
    scan = next(n for n, x in enumerate(lines) if "FileScan" in x and re.search(r"\btext#", x))
    depth = lines[scan].index("FileScan")
    above, exchanges = depth, 0
    for x in reversed(lines[:scan]):
        column = len(x) - len(x.lstrip(" :+-*"))
        if column < above:
            above = column
            exchanges += "Exchange" in x
    assert exchanges == 1


def test_current_tables_need_no_shuffle(spark, tmp_path):
    path = dump_of(tmp_path, page(1, "A", revision(10)))
    made = convert.convert_current(spark, path)
    assert all("Exchange" not in plan(made[t]) for t in ("page", "revision", "text", "recentchanges"))


def test_corpus_from_a_dump(spark, tmp_path):
    path = dump_of(tmp_path, page(7, "A", revision(1, "old"), revision(2, "x [[Category:One]][[Category:Two]]")),
                   page(3, "B", revision(3, "y [[Category:One]]")), page(4, "C", revision(4, "none")))
    convert.create_corpus(spark, path, str(tmp_path / "corpus"))
    rows = spark.read.parquet(str(tmp_path / "corpus")).select("category", "ordinal", F.substr("article", F.lit(1), F.lit(1)).alias("a"))
    assert sorted(map(tuple, rows.collect())) == [("One", 0, "x"), ("One", 1, "y"), ("Two", 0, "x")]


def test_scratch_can_be_emptied(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "shared"))
    made = convert.convert_dump(spark, dump_of(tmp_path, page(1, "A", revision(10))))
    assert made["page"].count() == 1 and list((tmp_path / "shared" / "dumptables").iterdir())
    session.drop_scratch(spark)
    assert not (tmp_path / "shared" / "dumptables").exists()


def test_scratch_is_where_all_executors_reach(spark, monkeypatch):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Elsewhere:
        conf = {"spark.checkpoint.dir": "file:/tmp/x"}
        sparkContext = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()  # noqa: N815

    with pytest.raises(RuntimeError):
        session.shared_dir(Elsewhere())
    Elsewhere.conf = {"spark.sql.warehouse.dir": "hdfs://host/wh/"}
    assert session.shared_dir(Elsewhere()) == "hdfs://host/wh/_scratch"
