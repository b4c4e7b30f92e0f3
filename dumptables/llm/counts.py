"""Token counts by a longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, map_batches, slices, texts

#: Words whose counts a task remembers; a full memory is emptied.
MEMORY = 400_000
WORD_START = "▁"


class CountAutomaton:
    """Greedy longest-match word-piece lengths of a word in one pass over its characters.

    The trie holds pieces that begin a word (marked by ``WORD_START``) and pieces inside a word. A failure link leads
    to the state reached after the longest matching pieces of the text read so far have been popped, and ``popped``
    has the number of those pieces, so counting never builds one. All states are numbered; ``step`` has the moves.
    """

    def __init__(self, pieces: Iterable[str]):
        self.step: list[dict[str, int]] = [{}, {}]  # 0: where words begin; 1: inside a word
        token = [False, False]
        for piece in pieces:
            if piece.startswith(WORD_START):
                node, rest = 0, piece[1:]
            else:
                node, rest = 1, piece
            if WORD_START in rest:
                continue  # pieces of several spaces are no part of a word
            if not rest:
                token[node] = node == 0  # the bare word start is a piece of its own
                continue
            for char in rest:
                if char not in self.step[node]:
                    self.step[node][char] = len(self.step)
                    self.step.append({})
                    token.append(False)
                node = self.step[node][char]
            token[node] = True
        self.fail = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        if token[0]:
            self.fail[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for char, node in self.step[parent].items():
                    below.append(node)
                    if token[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and char not in self.step[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.step[at][char], count
            level = below

    @classmethod
    def public(cls) -> CountAutomaton:
        """Over the 32,000 pieces of the public vocabulary, control and byte pieces left out."""
        import public_tokenizers as files
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
        return cls(
            model.id_to_piece(i) for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))

    def count(self, word: str) -> int:
        """Number of greedy pieces of ``word``; a word that cannot be covered counts as one unknown piece."""
        step, fail, popped = self.step, self.fail, self.popped
        node, total = 0, 0
        for char in word:
            while char not in step[node]:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = step[node][char]
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def count_tokens(docs: DataFrame, automaton=CountAutomaton.public, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens): words between white space, and their greedy word pieces, over whole texts.

    Null and empty texts count 0. One row for each row given, repeated ids included. No shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        machine = automaton()
        known: dict[str, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in texts(batch):
                words_here = tokens_here = 0
                for part in slices(text):
                    words = part.split()
                    found = list(map(known.get, words))
                    if None in found:
                        if len(known) > MEMORY:
                            known.clear()
                        for n, got in enumerate(found):
                            if got is None:
                                word = words[n]
                                got = known.get(word)
                                found[n] = known.setdefault(word, machine.count(word)) if got is None else got
                    words_here += len(words)
                    tokens_here += sum(found)
                n_words.append(words_here)
                n_tokens.append(tokens_here)
            yield {"doc_id": longs(batch, "id"), "n_words": n_words, "n_tokens": n_tokens}

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, work, "doc_id bigint, n_words bigint, n_tokens bigint")
