import random
import re
from collections import defaultdict

import pytest
from helpers import documents, odd_rows

from dumptables.llm import suffix as s


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(rows):
    """{id: (repeated starts, starts that repeat an earlier one)}."""
    places = defaultdict(list)
    for i, text in rows:
        w = words_of(text)
        for p in range(len(w) - s.LENGTH + 1):
            places[tuple(w[p:p + s.LENGTH])].append((i, p))
    found = defaultdict(lambda: (set(), set()))
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                found[i][0].add(p)
                if (i, p) != min(at):
                    found[i][1].add(p)
    return found


def check(spark, rows):
    got = defaultdict(lambda: (set(), set()))
    for r in s.repeated_passages(documents(spark, rows)).collect():
        starts = set(range(r.start_word, r.start_word + r.n_words - s.LENGTH + 1))
        got[r.doc_id][0].update(starts)
        if r.cut:
            got[r.doc_id][1].update(starts)
            assert r.first_id <= r.doc_id
    assert dict(got) == dict(brute(rows))


def passages(seed):
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 60, 90, 300)] + [["same"] * 70]
    rows = []
    for i in range(60):
        text = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            low = rng.randint(0, max(0, len(part) - 52))
            text += part[low:rng.randint(low, len(part))] if rng.random() < 0.4 else part
            text += some(rng.randint(0, 8))
        rows.append((i, rng.choice([" ", ", ", " - "]).join(text)))
    return rows + [(100, rows[5][1]), (101, rows[5][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_all_windows(spark, seed):
    check(spark, passages(seed))


def test_odd_rows_and_empty(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(20, "many words " * 40)]
    check(spark, rows)
    assert s.repeated_passages(documents(spark, [])).count() == 0
    assert s.repeated_passages(documents(spark, [(1, "too short"), (None, None)])).count() == 0


def test_cut_texts_keep_the_first_occurrence(spark):
    rows = passages(3)
    docs = documents(spark, rows).withColumnRenamed("node", "place")
    out = s.drop_repeats(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    cut = {i: found[1] for i, found in brute(rows).items()}
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for i, text in rows:
        gone = {w for p in cut.get(i, ()) for w in range(p, p + s.LENGTH)}
        assert words_of(texts[i][0]) == [w for n, w in enumerate(words_of(text)) if n not in gone]
        assert texts[i][1] == len(texts[i][0])
        if not gone:
            assert texts[i][0] == text


def test_rows_without_an_id_lose_what_they_repeat(spark):
    part = " ".join(f"p{n}" for n in range(60))
    ends = [f"{e} " * 3 for e in "abcd"]
    one = [(None, f"{part} {ends[0]}{part}"), (1, part + " " + ends[1])]
    assert sorted(words_of(r.text) for r in s.drop_repeats(documents(spark, one)).collect()) == sorted(
        [words_of(part + " " + ends[0]), words_of(ends[1])])
    many = [(None, f"{part} {e}") for e in ends] + [(None, f"{part} {ends[0]}"), (7, part)]
    got = [words_of(r.text) for r in s.drop_repeats(documents(spark, many)).collect()]
    assert len(got) == 6 and sum("p0" in w for w in got) == 1
    assert sum(len(w) for w in got) == 60 + 4 * 3 and sum(not w for w in got) == 2


def test_rows_that_share_an_id_lose_only_what_they_repeat(spark):
    part = " ".join(f"p{n}" for n in range(60))
    other = " ".join(f"q{n}" for n in range(100))
    rows = [(1, part), (5, "some words before " + part), (5, other), (6, other + " and more")]
    got = sorted((r.doc_id, " ".join(words_of(r.text)), r.n_chars) for r in s.drop_repeats(documents(spark, rows)).collect())
    assert got == [(1, part, len(part)), (5, other, len(other)), (5, "some words before", 17), (6, "and more", 8)]


def test_letters_that_grow_in_lower_case_do_not_move_the_cut(spark):
    part = " ".join(f"p{n}" for n in range(60))
    before, after = "\u0130stanbul D\u0130YE " * 6, "clean words that stay"
    rows = [(1, part), (2, f"{before}{part} {after}")]
    got = {r.doc_id: r.text for r in s.drop_repeats(documents(spark, rows)).collect()}
    assert got == {1: part, 2: f"{before.strip()}\n{after}"}
    assert len(s.Suffixes().words(before)) == 12


def test_equal_passages_retain_the_same_suffix():
    rng = random.Random(4)
    suffixes = s.Suffixes()
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(s.LENGTH))
    ends = set()
    for _ in range(20):
        before = rng.randint(0, 200)
        text = " ".join([f"b{rng.randint(0, 99)}" for _ in range(before)] + [passage] + [f"a{rng.randint(0, 99)}" for _ in range(rng.randint(0, 90))])
        words = suffixes.words(text)
        first, last, place = suffixes.retained(words)
        ends |= {int(p) - before for low, high, p in zip(first, last, place) if low <= before <= high}
        assert len(place) < 0.12 * len(words) + 3 and first[0] == 0 and last[-1] == len(words) - s.LENGTH
    assert len(ends) == 1
