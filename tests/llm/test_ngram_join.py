import random
import re
from fractions import Fraction

import numpy as np
from helpers import documents, odd_rows

from dumptables.llm import ngram_join as n
from dumptables.llm.components import connected_components


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    size = min(5, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if size else frozenset()


def near_copies(count, seed=1, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    out = []
    for _ in range(count):
        changed = list(base)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(len(changed))] = f"x{rng.randint(0, 9)}"
        out.append(" ".join(changed))
    return out


def brute(rows):
    """{row number: (class id, copy id, links)} with exact similarities."""
    sets = [shingle_set(t) for _, t in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    copies = [[j for j in range(len(rows)) if sets[i] == sets[j]] if sets[i] else [i] for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and Fraction(both, len(sets[i]) + len(sets[j]) - both) >= Fraction(4, 5):
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    smallest = lambda members: min((rows[j][0] is not None, rows[j][0] or 0) for j in members)
    found = []
    for i in range(len(rows)):
        members = [j for j in range(len(rows)) if group[j] == group[i]]
        found.append(tuple(v if known else None for known, v in (smallest(members), smallest(copies[i]))) + (links[i],))
    return found


def check(spark, rows, **options):
    got = n.near_duplicates(documents(spark, rows), **options).collect()
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    want = [(r[0], *b) for r, b in zip(rows, brute(rows))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_classes_and_links_against_all_pairs(spark):
    rng = random.Random(9)
    texts = near_copies(70) + near_copies(5, 2) + [" ".join(f"u{rng.randint(0, 400)}" for _ in range(40)) for _ in range(25)]
    texts += texts[:15] + [texts[0]] * 20
    rng.shuffle(texts)
    # Blocks of a few documents make large groups meet across blocks.
    check(spark, list(enumerate(texts)), block=8)


def test_odd_rows(spark):
    check(spark, odd_rows())
    assert n.near_duplicates(documents(spark, [])).count() == 0


def test_pairs_and_one_document_of_each_group(spark):
    rows = list(enumerate(near_copies(12, 5) + ["some other words that are alone here", "a", "a", ""]))
    sets = [shingle_set(t) for _, t in rows]
    first = [min(j for j in range(len(rows)) if sets[j] == sets[i]) for i in range(len(rows))]
    want = set()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and sets[i] != sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                want.add((min(first[i], first[j]), max(first[i], first[j])))
    docs = documents(spark, rows)
    assert {tuple(r) for r in n.similar_pairs(docs, block=4).collect()} == want
    kept = n.drop_near_duplicates(docs, block=4)
    assert kept.columns == docs.columns
    classes = {r[0] for r in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    twice = documents(spark, [(1, "the same text twice over"), (1, "the same text twice over"), (2, "another text that is not it")])
    assert sorted(r.doc_id for r in n.drop_near_duplicates(twice).collect()) == [1, 2]


def test_rows_without_an_id_lose_their_copies(spark):
    texts = [" ".join(f"w{m}" for m in range(60)) + f" x{n}" for n in range(6)]
    alone = "words of a text that nothing else here is like"
    one = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (20, alone)]
    assert sorted((r.doc_id or 0, r.doc_id is None) for r in n.drop_near_duplicates(documents(spark, one)).collect()) == [(0, True), (20, False)]
    many = one + [(None, t) for t in texts] + [(None, alone + " but one"), (None, None), (None, ""), (None, "")]
    kept = n.drop_near_duplicates(documents(spark, many)).collect()
    assert sum(r.text in texts for r in kept) == 1 and all(r.doc_id is None for r in kept if r.text in texts)
    assert sorted(r.text or "" for r in kept if r.text not in texts) == sorted(["", "", "", alone, alone + " but one"])


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    base = " ".join(f"w{m}" for m in range(60))
    alone = "words of a text that nothing else here is like"
    rows = [(1, base), (5, base + " more"), (5, alone), (6, base + " less"), (6, base), (7, ""), (7, ""), (7, None), (8, alone), (8, "!")]
    got = [(r.doc_id, r.text) for r in n.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, base), (5, alone), (7, ""), (7, None), (8, "!")], key=str)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = [n.least_matches(m, 0.8, 1e-6) for m in (40, 80, 120, 160, 200)]
    assert least == sorted(least) and all(0 < m < 0.8 * c for m, c in zip(least, (40, 80, 120, 160, 200)))
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 200, np.uint32)
    rows = np.stack([np.where(rng.random(200) < s, base, rng.integers(0, 1 << 32, 200, np.uint32)) for s in (1, 0.9, 0.8, 0.2, 0.0)])
    a, b = n.surviving_pairs(rows, base[None], False, 0.8, 1e-6)
    assert {0, 1, 2} <= set(a.tolist()) and not {3, 4} & set(a.tolist()) and set(b.tolist()) == {0}


def test_exact_similarity_in_both_forms():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), np.uint64)) for _ in range(30)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    want = [len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) for i, j in zip(a, b)]
    assert np.allclose(n.exact_jaccard(sets, sets, a, b), want)
    assert np.allclose(n.exact_jaccard(sets, sets, a[:50], b[:50]), want[:50])


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7), (None, 3)]
    edges += [(500, 501 + i) for i in range(50)]
    group = {}
    for a, b in edges:
        if a is not None and a != b:
            group.setdefault(a, a), group.setdefault(b, b)
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if g == old else g for k, g in group.items()}
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(group.items())
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
