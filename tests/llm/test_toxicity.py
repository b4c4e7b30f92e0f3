import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from helpers import documents, odd_rows

from dumptables.llm import toxicity as t

SF = Path("/root/testdata/sf0.1")
LABELS = "doc_id bigint, quality int, toxic int"


def made(n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 80)}" for _ in range(rng.randint(5, 40))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words += [rng.choice(["grumble", "snarlish", "snarling", "snarled"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_unseen_rows_are_told_apart(spark):
    rows, labels = made()
    docs = documents(spark, rows)
    model = t.train_toxicity(docs, spark.createDataFrame(labels, LABELS))
    truth = {i: y for i, _, y in labels}
    got = t.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) == truth[r.doc_id]
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, y in truth.items() if not y}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = made()
    docs = documents(spark, rows)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    scores = [{r.doc_id: r.score for r in t.score_toxicity(docs, t.train_toxicity(docs, spark.createDataFrame(x, LABELS))).collect()}
              for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    rows, labels = made()
    docs = documents(spark, rows + [(1000 + (i or 0), text) for i, text in odd_rows()] + [(None, "grumble")])
    odd_labels = labels + [(1004, None, None), (None, 1, 1), (1005, 0, 0), (1005, 0, 1), (99999, 1, 1)]
    got = t.score_toxicity(docs, t.train_toxicity(docs, spark.createDataFrame(odd_labels, LABELS))).collect()
    assert len(got) == len(rows) + len(odd_rows()) + 1 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1001, 1002))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(n, 1, 1) for n in range(50)]])
def test_without_labels_of_both_kinds_every_score_is_0(spark, labels):
    docs = documents(spark, made(60)[0])
    model = t.train_toxicity(docs, spark.createDataFrame(labels, LABELS))
    assert model is None and {r.score for r in t.score_toxicity(docs, model).collect()} == {0.0}
    assert t.score_toxicity(docs.limit(0), model).count() == 0


def test_label_model_discounts_echoes():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    noisy = lambda p: np.where(rng.random(4000) < p, truth, ~truth)
    good, echo = [noisy(0.85) for _ in range(3)], noisy(0.6)
    votes = np.where(np.stack([*good, *[echo] * 8], 1), t.YES, t.NO).astype(np.int8)
    given = noisy(0.9).astype(int)
    q = t.label_posteriors(votes, given)
    assert ((q > 0.5) == truth).mean() > 0.93


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(str(SF / f"{n}.parquet")) for n in ("documents", "labels"))
    scored = t.score_toxicity(docs, t.train_toxicity(docs, labels)).where("held_out").join(labels, "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = counts[(1, 1)], counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.85
