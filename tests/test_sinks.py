import glob

import pytest
from pyspark.sql import functions as F

from dumptables.operators import corpus, sinks, tables
from dumptables.operators.pages_map import map_pages


def read(path):
    return [open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*"))]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.range(600).select(
        F.col("id").alias("old_id"), F.concat(F.lit("it's \"x\"\n\\"), F.col("id").cast("string")).alias("old_text"),
        F.lit(None).cast("string").alias("old_flags"))


def test_insert_statements(spark, stored, tmp_path):
    lines = sinks.mysql_insert_lines(stored, "text", ["old_id"]).orderBy("idx").collect()
    per_statement = {}
    for r in lines:
        per_statement.setdefault(r.statement, []).append(r.line)
    assert [len(v) for v in per_statement.values()] == [256, 256, 88]
    for statement in per_statement.values():
        assert statement[0].startswith("INSERT INTO `text` VALUES (") and statement[-1].endswith(");")
        assert all(s.startswith(",(") for s in statement[1:])
    assert lines[3].line == ",(3,'it\\'s \\\"x\\\"\\n\\\\3',NULL)"


def test_insert_files_are_whole_scripts(spark, stored, tmp_path):
    sinks.write_mysql_insert(stored, "text", str(tmp_path / "sql"), ["old_id"], rows_per_file=256)
    text = "".join(read(tmp_path / "sql"))
    assert text.count("LOCK TABLES `text` WRITE;") == 3 and text.count("UNLOCK TABLES;") == 3
    assert text.count("INSERT INTO") == 3
    sections = text.split("/*!40000 ALTER TABLE `text` DISABLE KEYS */;\n")[1:]
    for section in sections:
        lines = section.splitlines()
        assert lines[0] == "LOCK TABLES `text` WRITE;" and lines[-2].startswith("/*!40000 ALTER TABLE `text` ENABLE")
        assert lines[-4].endswith(");")
    with pytest.raises(ValueError):
        sinks.write_mysql_insert(stored, "text", str(tmp_path / "x"), ["old_id"], rows_per_file=100)


def test_copy_files(spark, stored, tmp_path):
    sinks.write_pg_copy(stored, "text", str(tmp_path / "copy"), ["old_id"], rows_per_file=250)
    text = "".join(read(tmp_path / "copy"))
    assert text.count('COPY "text" FROM STDIN;\n') == 3 and text.count("\n\\.\n\n") == 3
    assert "\n3\tit's \"x\"\\n\\\\3\t\\N\n" in text


def test_bucketed_tables_keep_texts_in_place(spark, conf, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    ids = spark.range(100)
    page = ids.select(F.col("id").alias("page_id"), (F.col("id") + 1000).alias("page_latest"))
    revision = ids.select((F.col("id") + 1000).alias("rev_id"), (F.col("id") + 2000).alias("rev_text_id"))
    text = ids.select((F.col("id") + 2000).alias("old_id"), F.concat(F.lit("t"), "id").alias("old_text"))
    sinks.save_tables({"page": page, "revision": revision, "text": text}, "bucketed", buckets=4)
    found = corpus.article_lookup(*[spark.table(f"bucketed.{t}") for t in ("page", "revision", "text")])
    assert {(r.page_id, r.article) for r in found.collect()} == {(i, f"t{i}") for i in range(100)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the ids on their way to the texts
    assert "Exchange" not in plan[plan.index("old_id"):].split("FileScan", 1)[1]
    spark.sql("DROP DATABASE bucketed CASCADE")


def test_tsv_reads_back(spark, stored, tmp_path):
    sinks.write_tsv(stored, str(tmp_path / "tsv"))
    fields = [line.split("\t") for part in read(tmp_path / "tsv") for line in part.splitlines()]
    back = {int(f[0]): f[1].replace("\\\\", "\0").replace("\\n", "\n").replace("\0", "\\") for f in fields}
    assert back == {r.old_id: r.old_text for r in stored.collect()}
    assert {f[2] for f in fields} == {"\\N"}


def test_packed_bytes_survive_export(spark, tmp_path):
    """Compressed bytes hold every special character; undo the escapes and they are the same."""
    text = spark.createDataFrame([(1, "".join(chr(33 + i * i % 90) for i in range(5000)), "")],
                                 "old_id BIGINT, old_text STRING, old_flags STRING")
    packed = tables.compress_text(text, "full").cache()
    sinks.write_tsv(packed, str(tmp_path / "tsv"))
    raw = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/tsv/part-*"))
    body = raw.rstrip(b"\n").split(b"\t")[1]
    undo = {b"0": b"\0", b"r": b"\r", b"n": b"\n", b"t": b"\t", b"\\": b"\\"}
    out, i = bytearray(), 0
    while i < len(body):
        step = 2 if body[i:i + 1] == b"\\" else 1
        out += undo[body[i + 1:i + 2]] if step == 2 else body[i:i + 1]
        i += step
    assert bytes(out) == bytes(packed.first().old_text)
    packed.unpersist()


def test_corpus_folders(spark, tmp_path, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pages = spark.createDataFrame(
        [(5, 3, "x [[Category:A B]] [[Category:A B]]"), (6, 1, "none"), (7, 2, "[[Category:A B]][[Category:C]]")],
        "page_id BIGINT, page_seq BIGINT, text STRING")
    rows = corpus.corpus_rows(pages)
    assert sorted((r.category, r.ordinal) for r in rows.collect()) == [("A B", 1), ("A B", 2), ("C", 1)]
    corpus.write_corpus(rows, str(tmp_path / "corpus"), articles_per_file=1)
    assert len(glob.glob(f"{tmp_path}/corpus/category=A B/*.parquet")) == 2
    assert {r.category: r.n_pages for r in corpus.category_counts(pages).collect()} == {"A B": 2, "C": 1}


def test_jdbc_options(monkeypatch, spark):
    seen = {}
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.jdbc",
                        lambda self, url, table, mode=None, properties=None: seen.update(
                            url=url, table=table, mode=mode, properties=properties))
    sinks.write_jdbc(spark.range(1), "jdbc:x", "page", {"user": "u"})
    assert seen == {"url": "jdbc:x", "table": "page", "mode": "append",
                    "properties": {"user": "u", "batchsize": "10000"}}


def test_map_pages(spark):
    out = map_pages(spark.range(10), lambda f: f[f["id"] % 2 == 0], "id BIGINT")
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
