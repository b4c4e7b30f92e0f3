import random
import re
import zlib
from collections import Counter

from helpers import documents, odd_rows

from dumptables.llm import spelling
from dumptables.llm.spelling import near_in_tiles, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{word}".encode())
                if h % 199 == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        top = min(near, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= 5 * n else None
        out[w] = [form, n, len(near), None if form is None else words[form]]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row.insert(1, root)
    return sorted((w, *row) for w, row in out.items())


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeéfgh"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(25)]
    words = []
    for base in bases:
        words += [base] * rng.choice([5, 30, 200])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            variant = rng.choice([base[:at] + base[at + 1:], base[:at] + rng.choice(letters) + base[at:], base[:at] + rng.choice(letters) + base[at + 1:]])
            words += [variant.upper() if rng.random() < 0.2 else variant] * rng.choice([1, 5, 6, 40])
    rng.shuffle(words)
    rows, at = [], 0
    while at < len(words):
        take = rng.randint(1, 40)
        rows.append((len(rows) if rng.random() > 0.1 else None, " ".join(words[at:at + take]) + rng.choice(["", ".", " 12 ", "-x"])))
        at += take
    return rows


def test_equals_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        assert got(spelling_variants(documents(spark, rows))) == brute(rows)


def test_small_tiles_give_the_same(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(spelling, "TILE", 2)
    assert got(spelling_variants(documents(spark, rows))) == brute(rows)


def test_chain_of_forms(spark):
    rows = [(i, "colour " * 125 + "colours " * 0) for i in range(1)] + [(100, "coluor " * 1)]
    rows = [(1, "abcdefg " * 125), (2, "abcdeff " * 25), (3, "abcdfff " * 5), (4, "zzzzzz " * 5)]
    out = {r[0]: r for r in got(spelling_variants(documents(spark, rows)))}
    assert out == {r[0]: r for r in brute(rows)}
    assert out["abcdfff"][1:3] == ("abcdeff", "abcdefg")
    assert out["zzzzzz"][1:3] == (None, "zzzzzz")


def test_near_in_tiles():
    rng = random.Random(3)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(300)})
    assert sorted(near_in_tiles(words, words)) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_odd_rows_and_empty(spark):
    rows = odd_rows() + [(10, "Straße STRASSE strasse " * 5), (None, "Widely widely " * 5)]
    assert got(spelling_variants(documents(spark, rows))) == brute(rows)
    assert spelling_variants(documents(spark, [])).count() == 0
