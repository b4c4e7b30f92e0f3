import hashlib
import random

import numpy as np
from helpers import documents, odd_rows

from dumptables.llm import winnow as w


def brute(text, k, window):
    if not text:
        return []
    points = np.array([ord(c) for c in text], "<u4")
    if len(text) < 2 * k:
        k = max(1, min(k, len(text) // 4))
    window = max(1, min(window, (len(text) - k + 1) // w.LEAST))
    top = [h >> 32 for h in w.gram_hashes(points, k).tolist()]
    chosen = set()
    for i in range(len(top) - window + 1):
        least = min(top[i:i + window])
        chosen.add(max(j for j in range(i, i + window) if top[j] == least))
    return sorted(chosen)


def test_rightmost_minimum_of_each_window(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(w, "LEAST", 3)
    for k, window in ((1, 1), (3, 4), (5, 7), (7, 3)):
        for chunk in (23, 1 << 20):
            monkeypatch.setattr(w, "CHUNK", chunk)
            for _ in range(40):
                text = "".join(rng.choice("ab é漢😀") for _ in range(rng.randint(0, 150)))
                assert w.winnow(text, k, window)[0].tolist() == brute(text, k, window)


def test_common_passages_are_met_at_the_same_place():
    rng = random.Random(4)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = words(w.guarantee())
        left, right = words(rng.randint(0, 4000)), words(rng.randint(0, 4000))
        a, b = w.winnow(left + passage + words(50)), w.winnow(right + passage)
        mine = {(p - len(left), h) for p, h in zip(a[0].tolist(), a[1].tolist())}
        other = {(p - len(right), h) for p, h in zip(b[0].tolist(), b[1].tolist())}
        assert any(0 <= p <= len(passage) - w.K for p, _ in mine & other)


def test_edited_texts_against_a_loop(spark):
    rows = odd_rows() + [(n, f"text {n} " * n) for n in range(20, 60)]
    got = {}
    for r in w.edited_likeness(documents(spark, rows)).collect():
        got.setdefault((r.doc_id, r.n_chars), []).append(r)
    ordered = sorted((-(1 << 63) if i is None else i, t or "") for i, t in rows)
    assert sum(map(len, got.values())) == len(rows)
    for n, (i, text) in enumerate(ordered):
        follower = ordered[(n + 1) % len(ordered)][1]
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + follower[:quarter]
        found = got[(None if i == -(1 << 63) else i, len(text))]
        assert hashlib.sha256(changed.encode()).hexdigest() in {r.edited_sha256 for r in found}
        assert all(r.fingerprint == w.digest(*w.winnow(text)) and 0 <= r.near_next <= 1 for r in found)
        assert w.likeness(w.winnow(text)[1], w.winnow(changed)[1]) in {r.near_edited for r in found}


def test_empty_and_single(spark):
    assert w.edited_likeness(documents(spark, [])).count() == 0
    one = w.edited_likeness(documents(spark, [(3, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_fingerprints_of_odd_rows(spark):
    rows = odd_rows()
    got = w.fingerprint(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {tuple(r.places) for r in got if r.id in (1, 2)} == {()}
    assert len({tuple(r.hashes) for r in got if r.id in (4, 5)}) == 1
