import random

from helpers import documents, odd_rows

from dumptables.llm.counts import CountAutomaton, count_tokens


def greedy(word, pieces):
    text, at, n = "▁" + word, 0, 0
    while at < len(text):
        end = next((j for j in range(len(text), at, -1) if text[at:j] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_counts_equal_greedy_matching():
    rng = random.Random(8)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        pieces |= {"▁" + p for p in list(pieces)[::2]} | ({"▁"} if rng.random() < 0.6 else set())
        machine = CountAutomaton(pieces)
        for _ in range(60):
            word = "".join(rng.choice("abcd" if rng.random() < 0.2 else "abc") for _ in range(rng.randint(1, 12)))
            assert machine.count(word) == greedy(word, pieces), (word, pieces)


def test_odd_rows(spark):
    rows = odd_rows()
    machine = CountAutomaton.public()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_tokens) for r in count_tokens(documents(spark, rows)).collect())
    want = sorted((i is None, i or 0, len((t or "").split()), sum(map(machine.count, (t or "").split()))) for i, t in rows)
    assert got == want
    assert count_tokens(documents(spark, [])).count() == 0
