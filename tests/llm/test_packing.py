import random
import zlib

import numpy as np
import public_tokenizers
from helpers import documents, odd_rows
from tokenizers import Tokenizer

from dumptables.llm.common import slices
from dumptables.llm.packing import ByteTokenizer, OpenBins, pack_documents, plan_best_fit


def one_by_one(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, left in enumerate(bins) if left >= length]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


def test_runs_equal_best_fit_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 7, 10, 20, 33])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        plan, left = plan_best_fit(counts, capacity), {}
        for n, (length, rank, first, offset, each) in enumerate(plan):
            end = plan[n + 1][1] if n + 1 < len(plan) and plan[n + 1][0] == length else counts[length]
            for i in range(end - rank):
                bin_ = first + i // each
                assert capacity - left.get(bin_, capacity) == offset + i % each * length
                left[bin_] = left.get(bin_, capacity) - length
        assert sorted(left.values()) == one_by_one(counts, capacity)


def test_a_plan_does_not_grow_with_the_documents():
    small = {n: 10 for n in range(1, 101)}
    large = {n: 10_000_000 for n in range(1, 101)}
    assert len(plan_best_fit(large, 100)) < 4 * len(plan_best_fit(small, 100)) + 1000


def test_tightest_bin():
    bins = OpenBins(20)
    for left in (3, 9, 20):
        bins.add(left, left, 1)
    assert [bins.tightest(n) for n in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    bins.take(20, 1)
    assert bins.tightest(10) is None


def test_ids_are_those_of_the_tokenizer():
    plain, ours, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ByteTokenizer.public(), random.Random(6)
    made = ["", " ", "  ", "a ", "  a  b", "a \n b", "\x1c a \x85 b", "I'm don't 's", "漢字 か", "a b", *(t or "" for _, t in odd_rows())]
    for _ in range(1500):
        made.append("".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "'s", "1", "!", "漢", "\t", "<|", "<|endoftext|>"]) for _ in range(12)))
    for text in made:
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ours.encode(text) == want
        assert b"".join(ours._slice(part) for part in slices(text, 5)) == want


def test_packed_documents(spark):
    rows = odd_rows() + [(100 + n, "some words of text " * n) for n in range(60)]
    got = pack_documents(documents(spark, rows), 64).collect()
    ours = ByteTokenizer.public()
    want = []
    for i, text in rows:
        ids = ours.encode(text or "") + bytes(4)
        total, start, piece = len(ids) // 4, 0, 0
        length = (total - 1) % 64 + 1
        while start < total:
            want.append((i, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            start, length, piece = start + length, 64, piece + 1
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(sequences) == len(one_by_one(counts, 64))


def test_no_documents(spark):
    assert pack_documents(documents(spark, [])).count() == 0
