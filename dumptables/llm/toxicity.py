"""Toxicity by weak supervision: mined voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, filter_batches, longs, map_batches, slices, texts

#: Labelled rows that the model is fitted on: those with the smallest hash of the id. The only bound on the input.
MAX_LABELLED = 40_000
#: Words and word beginnings that the voters and the classifier look for.
MAX_PATTERNS = 256
PREFIXES = (4, 5, 6)
MIN_SUPPORT = 4
LEXICONS = 24
THRESHOLD = 0.3
#: A given label counts as a voter that is right this often.
LABEL_ACCURACY = 0.97
MEMORY = 300_000

_WORDS = re.compile(r"[^\W\d_]+")
_LOUD = re.compile(r"[A-Z]{3,}[^a-z]{0,3}!")
ABSTAIN, NO, YES = 0, 1, 2


def words_of(text: str) -> set[str]:
    found: set[str] = set()
    for part in slices(text):
        found.update(_WORDS.findall(part.lower()))
    return found


def patterns_of(words: set[str]) -> set[str]:
    """Whole words as ``=word``, beginnings of longer words as ``^begin``."""
    found = {f"={w}" for w in words}
    for n in PREFIXES:
        found.update(f"^{w[:n]}" for w in words if len(w) >= n)
    return found


def _pattern_counts(rows: DataFrame) -> DataFrame:
    """(pattern, toxic, n): number of texts of each label that hold a pattern."""

    def work(batches: Iterator[pa.RecordBatch]):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts(batch), longs(batch, "toxic")):
                counts[toxic].update(patterns_of(words_of(text)))
            for toxic in (0, 1):
                if len(counts[toxic]) > MEMORY:
                    yield {"pattern": list(counts[toxic]), "toxic": [toxic] * len(counts[toxic]), "n": list(counts[toxic].values())}
                    counts[toxic].clear()
        for toxic in (0, 1):
            yield {"pattern": list(counts[toxic]), "toxic": [toxic] * len(counts[toxic]), "n": list(counts[toxic].values())}

    return map_batches(rows, work, "pattern string, toxic int, n bigint").groupBy("pattern").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))


def _mine_patterns(rows: DataFrame, max_patterns: int) -> list[str]:
    """Patterns that speak for toxicity most, by the log-likelihood ratio; longer ones only where they say more."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []

    def part(x: Column, total: float, row_total: Column) -> Column:
        return F.when(x > 0, x * F.log(x * F.lit(float(n1 + n0)) / (row_total * F.lit(float(total))))).otherwise(0.0)

    both = F.col("a") + F.col("b")
    gain = part(F.col("a"), n1, both) + part(F.col("b"), n0, both)
    found = (
        _pattern_counts(rows).where((F.col("a") >= MIN_SUPPORT) & (F.col("a") * n0 > 3 * F.col("b") * n1))
        .withColumn("gain", gain).orderBy(F.desc("gain"), F.length("pattern"), "pattern").limit(20 * max_patterns).collect())
    chosen: dict[str, float] = {}
    for r in found:
        pattern, precision = r["pattern"], (r["a"] + 0.5) / (r["a"] + r["b"] + 1)
        stem = pattern[1:]
        known = [chosen[p] for n in PREFIXES if (p := f"^{stem[:n]}") in chosen and p != pattern]
        if known and precision <= max(known) + 0.05:
            continue
        chosen[pattern] = precision
        if len(chosen) == max_patterns:
            break
    return list(chosen)


class PatternFinder:
    """Numbers of the patterns in a text; what a word holds is remembered."""

    def __init__(self, patterns: list[str]):
        self.place = {p: n for n, p in enumerate(patterns)}
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, words: set[str]) -> tuple[list[int], int]:
        """(patterns found, words that hold one)."""
        if len(self.known) > MEMORY:
            self.known.clear()
        found: set[int] = set()
        n = 0
        for word in words:
            held = self.known.get(word)
            if held is None:
                held = self.known[word] = tuple(self.place[p] for p in patterns_of({word}) if p in self.place)
            if held:
                found.update(held)
                n += 1
        return sorted(found), n


@dataclass
class ToxicityModel:
    patterns: list[str]
    weights: np.ndarray  # patterns, then the dense features, then the constant

    def score(self, hits: list[int], dense: np.ndarray) -> float:
        n = len(self.patterns)
        z = float(self.weights[hits].sum() + dense @ self.weights[n:-1] + self.weights[-1])
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _dense(n_hits: int, n_words: int, loud: int) -> np.ndarray:
    """Hit words, their share, and shouting; scaled to about 1."""
    return np.array([np.log1p(n_hits), min(n_hits, 2) / 2, min(1.0, 20 * n_hits / max(n_words, 1)), min(loud, 3) / 3])


def _features(docs: DataFrame, patterns: list[str], id_col: str = "doc_id") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    def work(batches: Iterator[pa.RecordBatch]):
        finder = PatternFinder(sent.value)
        for batch in batches:
            out = {"id": longs(batch, "id"), "toxic": longs(batch, "toxic"), "hits": [], "dense": []}
            for text in texts(batch):
                words = words_of(text)
                hits, n = finder.hits(words)
                out["hits"].append(hits)
                out["dense"].append(_dense(n, len(words), len(_LOUD.findall(text))).tolist())
            yield out

    return map_batches(docs, work, "id bigint, toxic int, hits array<int>, dense array<double>")


def vote(hits: list[list[int]], dense: np.ndarray, n_patterns: int) -> np.ndarray:
    """Votes of all voters, rows x voters: lexicons, numbers of hits, their share, and shouting."""
    groups = min(LEXICONS, max(1, n_patterns))
    votes = np.zeros((len(hits), groups + 5), np.int8)
    for row, found in enumerate(hits):
        votes[row, [h % groups for h in found]] = YES  # a lexicon that finds nothing abstains
        votes[row, groups] = YES if found else NO
    votes[:, groups + 1] = np.where(dense[:, 1] >= 1, YES, NO)
    votes[:, groups + 2] = np.where(dense[:, 0] >= np.log1p(3), YES, ABSTAIN)
    votes[:, groups + 3] = np.where(dense[:, 2] >= 0.5, YES, np.where(dense[:, 2] == 0, NO, ABSTAIN))
    votes[:, groups + 4] = np.where(dense[:, 3] > 0, YES, ABSTAIN)
    return votes


def label_posteriors(votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Generative label model: P(toxic | votes, label) by expectation maximization.

    Each voter has a table P(vote | class), and classes a share. Voters that still agree within a class are not
    independent: their correlations are estimated from the votes less their mean in the class, and a voter's
    evidence is divided by 1 plus the sum of its positive correlations, so that echoes count once.
    """
    n, m = votes.shape
    given = np.where(labels == 1, 1.0, -1.0) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    q = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY).astype(float)
    one_hot = [(votes == v).astype(np.float32) for v in (ABSTAIN, NO, YES)]
    for _ in range(rounds):
        share = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        tables = np.stack([
            np.stack([(h * w[:, None]).sum(0) + 1.0 for h in one_hot]) / (w.sum() + 3.0) for w in (1 - q, q)])
        evidence = np.log(tables[1]) - np.log(tables[0])  # votes x voters
        yes = one_hot[2].astype(float)
        rest = yes - (q[:, None] * tables[1][2] + (1 - q[:, None]) * tables[0][2])
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        related = np.clip((rest.T @ rest) / n / spread[:, None] / spread[None, :], 0, 1)
        np.fill_diagonal(related, 0)
        discount = 1 / (1 + related.sum(1))
        z = np.log(share / (1 - share)) + given + sum((h * (evidence[v] * discount)).sum(1) for v, h in enumerate(one_hot))
        q = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return q


def fit_linear(hits: list[list[int]], dense: np.ndarray, targets: np.ndarray, n_patterns: int, ridge: float = 1.0,
               rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the constant is not held down."""
    x = np.zeros((len(hits), n_patterns + dense.shape[1] + 1), np.float32)
    for row, found in enumerate(hits):
        x[row, found] = 1
    x[:, n_patterns:-1] = dense
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        slope = x.T @ (p - targets).astype(np.float32) + hold * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x + np.diag(hold)
        step = np.linalg.solve(bend.astype(float), slope.astype(float))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 leaves 2 when divided by 4 are never learnt from; a row without an id neither."""
    return F.coalesce(F.pmod(crc_of(id_col), F.lit(4)) == 2, F.lit(True))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                   max_patterns: int = MAX_PATTERNS) -> ToxicityModel | None:
    """Fit on the labelled documents that are not held out; None if there is no label of either kind.

    At most ``max_labelled`` rows are used, those with the smallest hash of the id; they are found in the documents
    by a broadcast of so many ids. Of several labels of a document the larger counts; null labels are no labels.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(known.withColumnRenamed("doc_id", "id")), "id")
    patterns = _mine_patterns(rows, max_patterns)
    if not patterns:
        return None
    sample = _features(rows, patterns).orderBy("id").collect()
    hits = [r["hits"] for r in sample]
    dense = np.array([r["dense"] for r in sample])
    given = np.array([r["toxic"] for r in sample])
    targets = label_posteriors(vote(hits, dense, len(patterns)), given)
    return ToxicityModel(patterns, fit_linear(hits, dense, targets, len(patterns)))


def scorer(model: ToxicityModel | None) -> Callable[[list[str]], list[float]]:
    """Scores of texts, 0 to 1; all 0 without a model."""
    finder = PatternFinder(model.patterns if model else [])

    def score(found: list[str]) -> list[float]:
        if model is None:
            return [0.0] * len(found)
        scores = []
        for text in found:
            words = words_of(text)
            hits, n = finder.hits(words)
            scores.append(float(model.score(hits, _dense(n, len(words), len(_LOUD.findall(text))))))
        return scores

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its whole text alone.

    Null and empty texts have no hits and get the score of such a text. Without a model every score is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]):
        score = scorer(sent.value)
        for batch in batches:
            yield {"doc_id": longs(batch, "id"), "score": score(texts(batch))}

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, work, "doc_id bigint, score double").select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Documents whose score is below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = scorer(sent.value)
        return lambda batch: [s < threshold for s in score(texts(batch, text_col))]

    return filter_batches(docs, start)
