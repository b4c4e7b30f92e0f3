"""Every registered query against its SQL, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import ENTRY_DIR, entry
from __spark_entry__ import oracle_sql as all_sql
from __spark_entry__ import queries as all_queries
from dumptables.plans.oracles import ORACLES
from dumptables.plans.queries import QUERIES

SF = Path(ENTRY_DIR)
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in SF.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(all_queries()) and set(ORACLES) <= set(all_sql())


def test_entry(spark):
    assert entry(spark).columns == ["page_id", "rev_id", "text_id", "article"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    db.register("got", df.toArrow())
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    columns = ", ".join(f"cast({c} as varchar) as {c}" for c in sorted(df.columns))
    ours, theirs = f"select {columns} from got", f"select {columns} from ({ORACLES[name]})"
    assert db.sql(f"{ours} except all {theirs}").limit(3).fetchall() == []
    assert db.sql(f"{theirs} except all {ours}").limit(3).fetchall() == []
