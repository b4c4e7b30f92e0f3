"""Language identification by known words first, then by ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .common import SLICE_CHARS, crc_of, filter_batches, letter_words, longs, map_batches, slices, store, texts

UNKNOWN = "und"
#: Bounds of the model that is sent to every task: what does not fit is looked up by joins with the whole counts.
MAX_WORDS = 50_000
MAX_GRAMS = 50_000
ORDERS = (5, 4, 3, 2, 1)
#: Words counted in a task before the counts are passed on; unseen words remembered when scoring.
HELD_WORDS = 200_000
SMOOTHING = 0.5
#: Evidence from the joins is added in steps of this size as whole numbers, so that its order does not matter.
STEPS = 1 << 30


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): counts of lower-case words over whole texts of (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]):
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                if counts:
                    yield {"lang": [lang] * len(counts), "word": [w.decode("utf-8", "replace") for w in counts],
                           "n": list(counts.values())}
                    counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                counts = held.setdefault(lang, Counter())
                for part in slices(text):
                    counts.update(letter_words(part))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return map_batches(rows, work, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(word: Column, order: int) -> Column:
    """All n-grams of one order of the word between its border marks."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    last = F.length(marked) - (order - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                         lambda at: F.substring(marked, at, F.lit(order)))).otherwise(F.array().cast("array<string>"))


def _largest(counts: DataFrame, key: str, most: int) -> tuple[list, DataFrame | None]:
    """The ``most`` most frequent keys (ties in order of the key) with their counts by language, and the table of all
    keys if there are more.

    A histogram of the totals in steps of one percent tells which steps are taken whole; only the step at the border
    is sorted. So no more than the keys asked for, and a part of one step, come to the driver.
    """
    by_key = store(counts.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang"))
                   .withColumn("step", F.floor(100 * F.log("total")).cast("int")), "largest")
    sizes = sorted(((r["step"], r["count"]) for r in by_key.groupBy("step").count().collect()), reverse=True)
    room, border = most, None
    for step, count in sizes:
        if count > room:
            border = step
            break
        room -= count
    if border is None:
        return by_key.collect(), None
    found = by_key.where(F.col("step") > border).collect()
    if room:
        found += by_key.where(F.col("step") == border).orderBy(F.desc("total"), key).limit(room).collect()
    return found, by_key


@dataclass
class LanguageModel:
    """Log probabilities by language of known words and n-grams; what is sent to tasks is bounded, whatever it was trained on.

    ``all_words`` (word, logs) and ``all_grams`` (gram, logs) are tables of all that was counted, where the bounds left
    some out. They stay in the shared folder.
    """

    langs: list[str]
    prior: np.ndarray
    words: dict[bytes, int]
    word_logs: np.ndarray
    grams: dict[str, np.ndarray]
    all_words: DataFrame | None = None
    all_grams: DataFrame | None = None

    def bounded(self) -> LanguageModel:
        return replace(self, all_words=None, all_grams=None)

    def backoff(self, word: str) -> np.ndarray:
        """Of the longest order with a known n-gram of the word, the mean log frequency; no evidence gives zeros."""
        marked = f"<{word}>"
        for order in ORDERS:
            found = [g for at in range(len(marked) - order + 1) if (g := self.grams.get(marked[at:at + order])) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))


def train_language_model(rows: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Learn from (lang, text): words and n-grams are counted over all rows and all of their texts.

    Rows without a language teach nothing. The counts are a Spark aggregation; only the most frequent words and
    n-grams, a fixed number, come to the driver; the rest stays in tables. n-grams are counted over the words' counts, not over the texts.
    """
    counts = store(_word_counts(rows.where(F.col("lang").isNotNull())), "words")
    totals = {r["lang"]: (r["n"], r["types"]) for r in counts.groupBy("lang").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    langs = sorted(totals)
    place = {lang: n for n, lang in enumerate(langs)}
    sizes = np.array([totals[lang][0] for lang in langs], float)
    kinds = float(sum(t for _, t in totals.values()))
    if not langs:
        return LanguageModel([], np.zeros(0), {}, np.zeros((0, 0)), {})

    def logs(row, of: np.ndarray, values: float) -> np.ndarray:
        seen = np.zeros(len(langs))
        for x in row["by_lang"]:
            seen[place[x["lang"]]] += x["n"]
        return np.log((seen + SMOOTHING) / (of + SMOOTHING * values))

    def table_of(by_key: DataFrame | None, key: str, of: np.ndarray, values: float) -> DataFrame | None:
        if by_key is None:
            return None
        seen = F.map_from_entries("by_lang")
        return by_key.select(key, F.array(*[
            F.log((F.coalesce(seen[lang], F.lit(0)) + SMOOTHING) / F.lit(float(of[n] + SMOOTHING * values)))
            for n, lang in enumerate(langs)]).alias("logs"))

    words, all_words = _largest(counts, "word", max_words)
    every = F.concat(*[_grams(F.col("word"), n) for n in ORDERS])
    # Every word teaches its n-grams once, so that unseen words meet the make-up of rare ones.
    gram_counts = counts.select("lang", F.explode(every).alias("gram")).groupBy("lang", "gram").agg(
        F.count(F.lit(1)).alias("n"))
    grams, all_grams = _largest(gram_counts, "gram", max_grams)
    types = np.array([totals[lang][1] for lang in langs], float)
    return LanguageModel(
        langs, np.log(sizes / sizes.sum()), {r["word"].encode(): n for n, r in enumerate(words)},
        np.array([logs(r, sizes, kinds) for r in words]).reshape(-1, len(langs)),
        {r["gram"]: logs(r, types, 1.0) for r in grams},
        table_of(all_words, "word", sizes, kinds), table_of(all_grams, "gram", types, 1.0))


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _decide(langs: list[str], total: np.ndarray, n: int) -> tuple[str, float]:
    """The likeliest language and its share, from the sum over n words."""
    share = total / max(1.0, n) ** 0.5
    share = np.exp(share - share.max())
    share /= share.sum()
    best = int(np.argmax(share))
    return langs[best], float(share[best])


def predictor(known: LanguageModel) -> Callable[[list[str]], tuple[list[str], list[float]]]:
    """(languages, scores) of texts. Unseen words are remembered with their n-grams' evidence; a full memory is emptied."""
    n_known = len(known.words)
    # A slice has fewer words than SLICE_CHARS, so it always finds room.
    table = np.zeros((n_known + HELD_WORDS + SLICE_CHARS, len(known.langs)))
    if n_known:
        table[:n_known] = known.word_logs
    place = dict(known.words)

    def learn(word: bytes) -> int:
        place[word] = at = len(place)
        table[at] = known.backoff(word.decode("utf-8", "replace"))
        return at

    def one(text: str) -> tuple[str, float]:
        nonlocal place
        if not known.langs or not _has_letter(text):
            return UNKNOWN, 0.0
        total, n = known.prior.copy(), 0
        for part in slices(text):
            words = letter_words(part)
            if len(place) + len(words) > len(table):
                place = dict(known.words)
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
            for miss in np.flatnonzero(at < 0).tolist():
                found = place.get(words[miss])
                at[miss] = learn(words[miss]) if found is None else found
            total += table[at].sum(axis=0)
            n += len(words)
        return _decide(known.langs, total, n)

    def predict(found: list[str]) -> tuple[list[str], list[float]]:
        pairs = [one(text) for text in found]
        return [lang for lang, _ in pairs], [score for _, score in pairs]

    return predict


def _sums(narrow: DataFrame, sent) -> DataFrame:
    """(row, id, total, n, rest) of (id, text): sums over the words that were sent, and counts of all others.

    ``total`` is null for a text without letters.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "id", "total", "n", "rest")}
            for doc_id, text in zip(longs(batch, "id"), texts(batch)):
                total, n, rest = known.prior.copy(), 0, Counter()
                lettered = _has_letter(text)
                for part in slices(text) if lettered else ():
                    words = letter_words(part)
                    places = np.fromiter(map(known.words.get, words, repeat(-1)), np.int64, len(words))
                    rest.update(words[miss] for miss in np.flatnonzero(places < 0).tolist())
                    total += known.word_logs[places[places >= 0]].sum(axis=0)
                    n += len(words)
                for name, value in (("row", at), ("id", doc_id), ("total", total.tolist() if lettered else None), ("n", n),
                                    ("rest", [{"word": w.decode("utf-8", "replace"), "n": k} for w, k in rest.items()])):
                    out[name].append(value)
                at += 1
            yield out

    return store(map_batches(narrow, work, "row bigint, id bigint, total array<double>, n bigint, "
                                           "rest array<struct<word:string,n:bigint>>"), "sums")


def _evidence(asked: DataFrame, model: LanguageModel) -> DataFrame:
    """(word, n_rows, logs) for each of the (word, n_rows): its log frequencies, or those of its longest known n-grams."""
    spark, langs = asked.sparkSession, range(len(model.langs))
    all_words = model.all_words
    if all_words is None:  # all words were sent, so these are unseen
        all_words = spark.createDataFrame([], "word string, logs array<double>")
    all_grams = model.all_grams
    if all_grams is None:
        all_grams = spark.createDataFrame([(g, v.tolist()) for g, v in model.grams.items()], "gram string, logs array<double>")
    found = store(asked.join(all_words, "word", "left"), "evidence")
    out, left = found.where(F.col("logs").isNotNull()), found.where(F.col("logs").isNull()).drop("logs")
    for order in ORDERS:
        grams = left.select("word", F.explode(_grams(F.col("word"), order)).alias("gram")).join(
            all_grams.where(F.length("gram") == order), "gram")
        means = grams.groupBy("word").agg(F.array(*[F.avg(F.col("logs")[n]) for n in langs]).alias("logs"))
        found = store(left.join(means, "word", "left"), "evidence")
        out = out.unionByName(found.where(F.col("logs").isNotNull()))
        left = found.where(F.col("logs").isNull()).drop("logs")
    return out


def _predict_by_joins(narrow: DataFrame, model: LanguageModel) -> DataFrame:
    """The same as ``predict_language`` where some words or n-grams were not sent: those are joined with the whole counts."""
    sent = narrow.sparkSession.sparkContext.broadcast(model.bounded())
    sums = _sums(narrow, sent)
    rest = sums.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    asked = store(rest.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows")), "asked")
    told = lookup(rest, _evidence(asked, model), ["word"], ["logs"], "n_rows", ["row"], "inner")
    more = told.groupBy("row").agg(F.array(*[
        F.sum(F.round(F.col("logs")[n] * STEPS).cast("bigint") * F.col("times")) for n in range(len(model.langs))]).alias("more"))

    def work(batches: Iterator[pa.RecordBatch]):
        langs = sent.value.langs
        for batch in batches:
            found = [(UNKNOWN, 0.0) if total is None else _decide(langs, np.array(total) + (np.array(more) / STEPS if more else 0.0), n)
                     for total, n, more in zip(*(batch.column(c).to_pylist() for c in ("total", "n", "more")))]
            yield {"id": longs(batch, "id"), "lang_pred": [lang for lang, _ in found], "score": [score for _, score in found]}

    return map_batches(sums.drop("rest").join(more, "row", "left"), work, "id bigint, lang_pred string, score double")


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row, from its whole text alone.

    Known words add their log frequency in each language; an unseen word adds that of its longest known n-grams. The
    score is the language's share after the sum is divided by the root of the number of words, so that long texts
    don't all score 1. A text that is null or has no letter, and any text under a model of no language, gives "und"
    with score 0. Ties go to the language first in order. One row for each row given. The bounds of the model that is
    sent don't change what is found: where they left out words or n-grams, the words that were not sent are joined with
    all counts.
    """

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    if model.all_words is not None or model.all_grams is not None:
        return _predict_by_joins(narrow, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]):
        predict = predictor(sent.value)
        for batch in batches:
            langs, scores = predict(texts(batch))
            yield {"id": longs(batch, "id"), "lang_pred": langs, "score": scores}

    return map_batches(narrow, work, "id bigint, lang_pred string, score double")


def drop_unknown(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Documents for which the model names a language, with all their columns; only "und" goes.

    A score is a share among all languages, so there is no bar on it: a short text in words that several share stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.bounded())

    def start():
        predict = predictor(sent.value)
        return lambda batch: [lang != UNKNOWN for lang in predict(texts(batch, text_col))[0]]

    return filter_batches(docs, start)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 is a multiple of 5 are never learnt from; a row without an id neither."""
    return F.coalesce(F.pmod(crc_of(id_col), F.lit(5)) == 0, F.lit(True))


def learn_languages(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Learn from the documents that are not held out and name a language."""
    rows = docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return train_language_model(rows, max_words, max_grams)


def identify_languages(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the documents that are not held out, and predict for all."""
    found = predict_language(docs, learn_languages(docs, max_words, max_grams))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
