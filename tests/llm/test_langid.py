import random
import zlib
from pathlib import Path

import pytest
from helpers import documents, odd_rows

from dumptables.llm import langid as g

SF = Path("/root/testdata/sf0.01")


def made(n=200):
    rng = random.Random(12)
    ends = {"xx": ["ska", "ski"], "yy": ["ment", "tion"]}
    return [(i, " ".join(rng.choice("bdglmn") + rng.choice("aeiou") + rng.choice(ends[lang]) for _ in range(20)), lang)
            for i in range(n) for lang in [rng.choice(["xx", "yy"])]]


def test_unseen_words_fall_back_to_their_endings(spark):
    model = g.learn_languages(documents(spark, made()))
    asked = documents(spark, [(1, "qrstska vwxski"), (2, "Zzment, qqtion!"), (3, "kkkk"), (4, None), (5, "12 ... 3"), (6, "")])
    got = {r.id: (r.lang_pred, r.score) for r in g.predict_language(asked, model).collect()}
    assert [got[i][0] for i in (1, 2)] == ["xx", "yy"] and got[3][0] in ("xx", "yy")
    assert all(got[i] == ("und", 0.0) for i in (4, 5, 6))
    kept = g.drop_unknown(asked, model)
    assert kept.columns == asked.columns and {1, 2} <= {r.doc_id for r in kept.collect()} <= {1, 2, 3}


def test_bounded_models_still_tell_languages(spark):
    model = g.train_language_model(documents(spark, made()), max_words=5, max_grams=30)
    assert len(model.words) == 5 and len(model.grams) == 30
    rows = made()
    got = {r.id: r.lang_pred for r in g.predict_language(documents(spark, rows), model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.97 * len(rows)


def test_a_rare_language_keeps_its_words_in_a_bounded_model(spark):
    rng = random.Random(5)
    some = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    much, rare = [some(6) for _ in range(400)], [some(6) for _ in range(40)]
    learn = [(i, " ".join(rng.choices(much, k=50)), "xx") for i in range(400)] + [(i, " ".join(rng.choices(rare, k=10)), "yy") for i in range(9)]
    asked = [(i, " ".join(rng.choices(rare, k=12) + [some(5)])) for i in range(40)] + [(50, much[0]), (51, None), (52, "7"), (53, "q " * 5), (None, "éé")]
    whole, bounded = (g.train_language_model(documents(spark, learn), *most) for most in ((9999, 99999), (200, 300)))
    assert whole.all_words is whole.all_grams is None and len(bounded.words) == 200 and len(bounded.grams) == 300
    got, want = (sorted(map(tuple, g.predict_language(documents(spark, asked), m).collect()), key=str) for m in (bounded, whole))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-6)
    assert sum(r[1] == "yy" for r in got if r[0] is not None and r[0] < 40) == 40


def test_held_out_rows_teach_nothing(spark):
    rows = made()
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    one, two = (sorted(map(tuple, g.identify_languages(documents(spark, x)).collect())) for x in (rows, turned))
    assert one == two
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, held, _, _ in one)


def test_short_texts_in_shared_words_stay(spark):
    langs = [f"l{n}" for n in range(6)]
    model = g.train_language_model(documents(spark, [(n, f"common words of {lang * 3}", lang) for n, lang in enumerate(langs)]))
    asked = documents(spark, [(1, "common"), (2, "common words"), (3, "12"), (4, None)])
    assert all(r.score < 0.5 for r in g.predict_language(asked, model).collect())
    assert sorted(r.doc_id for r in g.drop_unknown(asked, model).collect()) == [1, 2]


def test_odd_rows(spark):
    rows = [(i, t, None if n % 2 else "en") for n, (i, t) in enumerate(odd_rows())]
    got = g.identify_languages(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "und"}
    none = g.identify_languages(documents(spark, [(1, "words", None), (2, "more", None)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert g.identify_languages(documents(spark, [])).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_held_out_accuracy_on_the_given_tables(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    got = g.identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.where("lang is not null").count()
