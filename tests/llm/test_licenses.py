import random
import re

from helpers import documents, odd_rows

from dumptables.llm import licenses
from dumptables.llm.licenses import BASE, TEMPLATES, find_blocks, license_scan


def words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(doc_id, text):
    ws = words(text)
    starts, base = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    met, best, n_blocks = set(), 0.0, 0
    for label, template in TEMPLATES:
        t = template.split()
        distinct = set(t)
        need = -(-4 * len(distinct) // 5)
        for b in range(max(1, len(ws) - len(t) + 1)):
            share = len(set(ws[b:b + len(t)]) & distinct)
            if share >= need:
                met.add(label)
                best = max(best, share / len(distinct))
                n_blocks += 1
    return (doc_id, len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | met)), best, n_blocks)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks").collect()),
                  key=repr)


def corpus(seed):
    rng = random.Random(seed)
    noise = ["the", "software", "license", "under", "mit", "by", "nc", "cc", "Apache", "version", "2", "gnu", "general", "public", "é", "free"]
    rows = []
    for i in range(60):
        parts = [rng.choice(noise) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            label, text = rng.choice(TEMPLATES + tuple((b[1], b[0]) for b in BASE))
            t = text.split()
            if rng.random() < 0.5 and len(t) > 3:
                t.pop(rng.randrange(len(t)))
            at = rng.randint(0, len(parts))
            parts[at:at] = [w.upper() if rng.random() < 0.2 else w for w in t]
        rows.append((i if rng.random() > 0.1 else None, rng.choice([" ", ", ", ".\n", "--"]).join(parts)))
    return rows


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert got(license_scan(documents(spark, rows))) == sorted((brute(*r) for r in rows), key=repr)


def test_data_lines():
    text = "Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, version 3."
    plan = licenses._plan({w: i for i, w in enumerate(sorted({w for _, t in TEMPLATES for w in t.split()}))})
    assert {b[0] for b in find_blocks(words(text), plan)} == {"apache-2", "gpl"}


def test_odd_rows_and_empty(spark):
    rows = odd_rows() + [(20, "UNDER THE MIT LICENSE under the mit license"), (21, "cc by nc by nc cc by nc")]
    assert got(license_scan(documents(spark, rows))) == sorted((brute(*r) for r in rows), key=repr)
    assert license_scan(documents(spark, [])).count() == 0
