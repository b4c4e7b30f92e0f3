import math
from collections import Counter

import numpy as np
import pytest
from helpers import documents, odd_rows

from dumptables.llm.sampling import Lattice, Pieces, Sampler, decode, sample_digests, sample_segmentations

VOCABULARY = [(" ", 0, -1.0), ("a", 1, -1.0), ("b", 2, -1.5), ("ab", 3, -1.2), (" a", 4, -1.4), ("aba", 5, -2.0)]


def small():
    return Pieces(VOCABULARY, range(10, 266))


def every_segmentation(text):
    text, found = " " + text, {}

    def go(at, ids, log):
        if at == len(text):
            found[tuple(ids)] = log
        for piece, number, weight in VOCABULARY:
            if text.startswith(piece, at):
                go(at + len(piece), [*ids, number], log + weight)

    go(0, [], 0.0)
    mass = math.log(sum(map(math.exp, found.values())))
    return {ids: log - mass for ids, log in found.items()}


def test_samples_follow_the_law_of_draws_without_replacement():
    text, n = "ab aba", 8000
    law = every_segmentation(text)
    first, pairs, total = Counter(), Counter(), 0.0
    for _, found in Sampler(small(), 3).batch(list(range(n)), [text] * n):
        ids = [tuple(i.tolist()) for i, _, _ in found]
        assert len(set(ids)) == 3
        assert all(log == pytest.approx(law[i]) for i, (_, log, _) in zip(ids, found))
        first[ids[0]] += 1
        pairs[tuple(ids[:2])] += 1
        total += sum(math.exp(law[i]) / q for i, (_, _, q) in zip(ids, found))
    assert all(abs(first[i] / n - math.exp(log)) < 0.02 for i, log in law.items())
    for a in law:
        for b in law:
            want = 0 if a == b else math.exp(law[a]) * math.exp(law[b]) / (1 - math.exp(law[a]))
            assert abs(pairs[(a, b)] / n - want) < 0.02
    assert total / n == pytest.approx(1, abs=0.05)  # inclusion scores weigh the samples to the whole


def test_all_segmentations_come_before_the_search_ends():
    law = every_segmentation("ab aba")
    ((_, found),) = Sampler(small(), 100).batch([3], ["ab aba"])
    assert {tuple(i.tolist()) for i, _, _ in found} == set(law) and all(q == 1 for _, _, q in found)


def test_samples_depend_on_the_key_only(spark):
    rows = odd_rows()
    one = {(r.id, r.sample, tuple(r.ids)) for r in sample_segmentations(documents(spark, rows), 3).collect()}
    other = {(r.id, r.sample, tuple(r.ids)) for r in sample_segmentations(documents(spark, rows[::-1]).repartition(7), 3).collect()}
    assert one == other


def test_round_trip_of_odd_rows(spark):
    rows = odd_rows()
    found = sample_segmentations(documents(spark, rows), 2)
    want = {}
    for i, text in rows:
        want.setdefault(i, set()).add(text or "")
    for r in decode(found.withColumn("text", found["id"])).collect():
        assert r.text in want[r.id]
    digests = sample_digests(documents(spark, rows), 2).collect()
    assert all(r.round_trip for r in digests) and {r.doc_id for r in digests} == set(want)
    assert sample_digests(documents(spark, []), 2).count() == 0


def test_edges_drawn_and_texts_decoded_are_those_of_plain_searches():
    """The scan over a node's edges, the counted places of edges and the gathered bytes take the place of slower searches."""
    public = Pieces.public()
    words = [" the", " cat", " aaaa", " 漢字x", "   ", " naïve"]
    lattice = Lattice(public, words)
    assert (np.diff(lattice.from_) >= 0).all()
    rng = np.random.default_rng(4)
    node = rng.integers(0, len(lattice.first) - 1, 5000)
    node = node[lattice.first[node] < lattice.first[node + 1]]
    u = rng.random(len(node))
    goal = lattice.before[node] + u * (lattice.before[node + 1] - lattice.before[node])
    want = np.clip(np.searchsorted(lattice.total, goal, side="right"), lattice.first[node], lattice.first[node + 1] - 1)
    assert (lattice.draw(node, u) == want).all()
    for ids in ([], [5], rng.integers(0, len(public.sizes), 400).tolist()):
        plain = b"".join(public.bytes[public.starts[n]:public.starts[n] + public.sizes[n]].tobytes() for n in ids)
        assert public.decode(np.array(ids, np.int32)) == plain[1:].decode("utf-8", "replace")


def test_public_pieces_are_read_once_in_a_process():
    assert Pieces.public() is Pieces.public()
