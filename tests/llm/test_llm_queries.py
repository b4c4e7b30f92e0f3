"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import ENTRY_DIR, oracle_sql, queries
from dumptables.llm.common import store
from dumptables.llm.queries import ORACLES, QUERIES

SF = Path(ENTRY_DIR)
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "language ID", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    db.register("got", df.toArrow())
    columns = ", ".join(f"cast({c} as varchar) as {c}" for c in sorted(df.columns))
    ours, theirs = f"select {columns} from got", f"select {columns} from ({ORACLES[name]})"
    assert db.sql(f"{ours} except all {theirs}").limit(3).fetchall() == []
    assert db.sql(f"{theirs} except all {ours}").limit(3).fetchall() == []


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    columns, before = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, before, str(SF)), "test")
        if name != "best-fit packing":
            assert after.columns == columns
        if name in ("toxicity", "language ID", "n-gram Jaccard join"):
            assert after.exceptAll(before).count() == 0  # rows go or stay as they are
        counts.append(after.count())
        last, before = before, after
    assert counts[0] > 0.7 * docs.count() and counts[2] < counts[1] and counts[3] == counts[2]
    assert {r.doc_id for r in before.select("doc_id").collect()} == {r.doc_id for r in last.select("doc_id").collect()}
    assert before.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, str(SF)).count() > 0
