from pyspark.sql import functions as F

from dumptables.plans import convert
from dumptables.streaming import ingest
from tests import dump_fixture as fx


def page(number, title, text="t"):
    return (f"<page><title>{title}</title><ns>0</ns><id>{number}</id><revision><id>{number}0</id>"
            f"<timestamp>2020-01-01T00:00:00Z</timestamp><text>{text}</text></revision></page>\n")


def run_titles(spark, folder, out, files=1):
    pages = ingest.stream_titles(spark, str(folder), files)
    writer = ingest.stream_dedup_titles(pages).writeStream.outputMode("update").foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    writer.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(str(out)).groupBy("full_title").agg(F.max_by("page_id", "batch").alias("page_id"))
    return {r.full_title: r.page_id for r in latest.collect()}


def test_the_latest_batch_has_the_first_page_of_a_title(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "b.xml").write_text("<mediawiki>" + page(1, "A b") + page(2, "A_b") + page(3, "C"))
    assert run_titles(spark, folder, out) == {"A_b": 1, "C": 3}
    # files that arrive later: the state of the first run still holds
    (folder / "c.xml").write_text(page(4, "C") + page(5, "D") + page(6, "D"))
    assert run_titles(spark, folder, out) == {"A_b": 1, "C": 3, "D": 5}
    # a file that arrives last and comes first in document order corrects the answer
    (folder / "a.xml").write_text(page(7, "C") + page(8, "E"))
    assert run_titles(spark, folder, out) == {"A_b": 1, "C": 7, "D": 5, "E": 8}


def test_one_batch_or_many_give_the_same_titles(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, name in enumerate("dacb"):
        (folder / f"{name}.xml").write_text("".join(page(10 * n + i, f"T{(n * i) % 4}") for i in range(5)))
    assert run_titles(spark, folder, tmp_path / "one", 100) == run_titles(spark, folder, tmp_path / "many", 1)


def test_ingest_in_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    fx.write(folder / "a.xml")
    (folder / "b.xml").write_text(page(900, "Z", "zz"))
    ingest.stream_ingest(ingest.stream_pages(spark, str(folder), 1), out, f"{out}-checkpoint").awaitTermination()
    rows = {r.page_id: r for r in spark.read.parquet(f"{out}/page").collect()}
    assert sorted(rows) == [10, 12, 13, 14, 17, 900]  # none without a revision
    assert (rows[10].page_latest, rows[10].page_len) == (102, len(fx.FIRST_TEXT))
    for name in ("revision", "text", "recentchanges"):
        assert spark.read.parquet(f"{out}/{name}").count() == len(rows)
    batches = {r.batch for r in spark.read.parquet(f"{out}/page").select("batch").distinct().collect()}
    assert batches == {0, 1}
    # the batch path follows the same rules
    made = convert.convert_current(spark, str(folder))
    for name in ("page", "revision", "text", "recentchanges"):
        streamed = spark.read.parquet(f"{out}/{name}").drop("batch")
        assert made[name].exceptAll(streamed).count() == 0 and streamed.exceptAll(made[name]).count() == 0
