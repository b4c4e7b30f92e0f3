"""SentencePiece segmentations sampled without replacement, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, map_batches, texts

#: Characters whose lattices are held at once.
CHUNK_CHARS = 600_000
#: Log weight of one byte where the vocabulary has no piece for a character.
BYTE_LOG = -12.0
#: Code points below this have a table of moves of their own.
DENSE = 256
NO_PIECE = -1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Random-like numbers strictly between 0 and 1, one for each 64-bit key."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64)
        z += np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    out = z.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def _keys(seed: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (seed.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(stream) * np.uint64(0x9FB21C651E98DF25)
                + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Pieces:
    """The vocabulary as a trie over characters (a space begins a word), with a log weight for each piece."""

    def __init__(self, pieces: Sequence[tuple[str, int, float]], byte_ids: Sequence[int]):
        """``pieces``: (text with spaces, id, log weight); ``byte_ids``: the ids of the 256 byte pieces."""
        step: list[dict[int, int]] = [{}]
        piece = [NO_PIECE]
        for text, number, _ in pieces:
            node = 0
            for char in map(ord, text):
                if char not in step[node]:
                    step[node][char] = len(step)
                    step.append({})
                    piece.append(NO_PIECE)
                node = step[node][char]
            piece[node] = number
        self.piece = np.array(piece, np.int32)
        self.dense = np.zeros((len(step), DENSE), np.int32)
        keys, moves = [], []
        for node, row in enumerate(step):
            for char, to in row.items():
                if char < DENSE:
                    self.dense[node, char] = to
                else:
                    keys.append((node << 21) | char)
                    moves.append(to)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.moves = np.array(keys, np.int64)[order], np.array(moves, np.int32)[order]
        size = max([n for _, n, _ in pieces] + list(byte_ids)) + 1
        self.logs = np.zeros(size)
        spelled: list[bytes] = [b""] * size
        for text, number, log in pieces:
            self.logs[number], spelled[number] = log, text.encode()
        self.byte_ids = np.array(byte_ids, np.int32)
        self.logs[self.byte_ids] = BYTE_LOG
        for value, number in enumerate(byte_ids):
            spelled[number] = bytes([value])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.fromiter(map(len, spelled), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def public(cls, alpha: float = 1.0) -> Pieces:
        """The public 32,000 pieces, read once in a process. The model scores merges by rank, so weights follow the law of Zipf: -alpha log(rank)."""
        return _public(cls, alpha)

    def move(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        low = char < DENSE
        if low.all():
            return self.dense[node, char]
        out = np.zeros(len(node), np.int32)
        out[low] = self.dense[node[low], char[low]]
        key = (node[~low].astype(np.int64) << 21) | char[~low]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[~low] = np.where(self.keys[at] == key, self.moves[at], 0)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation, without the space put in front of it."""
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)  # from a byte's place in the text to that in the pieces
        out = self.bytes[np.arange(sizes.sum()) + np.repeat(shift, sizes)]
        return out.tobytes()[1:].decode("utf-8", "replace")


@cache
def _public(cls: type[Pieces], alpha: float) -> Pieces:
    import public_tokenizers as files
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    plain, by_byte = [], {}
    for n in range(model.vocab_size()):
        if model.is_byte(n):
            by_byte[int(model.id_to_piece(n)[1:-1], 16)] = n
        elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
            plain.append((model.id_to_piece(n).replace("▁", " "), n, -alpha * float(np.log(2 - model.get_score(n)))))
    return cls(plain, [by_byte[b] for b in range(256)])


class Lattice:
    """All segmentations of a list of words, with the probability of each edge given that its start is reached.

    A word of n characters has n + 1 nodes. ``first`` has the first edge of each node; edges are sorted by node.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        stop = ends[word]
        self.start_node = ends - sizes + np.arange(len(words))
        self.end_node = ends + np.arange(len(words))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # start, place there, end, piece
        count = np.zeros(len(self.chars), np.int64)
        at, node, step = np.arange(len(self.chars)), np.zeros(len(self.chars), np.int32), 0
        alone = np.ones(len(self.chars), bool)
        while len(at):
            node = pieces.move(node, self.chars[at + step])
            at, node = at[node > 0], node[node > 0]
            hit = pieces.piece[node] != NO_PIECE
            begin = at[hit]
            found.append((begin, count[begin], begin + step + 1, pieces.piece[node[hit]]))
            count[begin] += 1
            if not step:
                alone[begin] = False
            step += 1
            more = at + step < stop[at]
            at, node = at[more], node[more]
        rest = np.flatnonzero(alone)  # no piece of its own: spelled in bytes, of which ASCII has one
        ascii_id = pieces.byte_ids[np.minimum(self.chars[rest], 127)]
        found.append((rest, count[rest], rest + 1, np.where(self.chars[rest] < 128, ascii_id, NO_PIECE).astype(np.int32)))
        count[rest] += 1
        begin, nth, end, piece = (np.concatenate(c) for c in zip(*found))
        to = (np.cumsum(count) - count)[begin] + nth  # edges in order of their starts, as found
        sorted_end, self.piece = np.empty_like(end), np.empty_like(piece)
        sorted_end[to], self.piece[to] = end, piece
        end = sorted_end
        each = np.arange(len(self.chars))
        begin, word_of = np.repeat(each, count), np.repeat(word, count)
        weight = pieces.logs[self.piece]
        bare = np.flatnonzero(self.piece == NO_PIECE)
        char = self.chars[begin[bare]]
        weight[bare] = BYTE_LOG * (1 + (char >= 0x80).astype(int) + (char >= 0x800) + (char >= 0x10000))
        self.from_, self.to = begin + word_of, end + word_of
        self.place = np.repeat(each - (ends - sizes)[word], count)  # of the edge's start in its word
        # Mass from each node to the end of its word, nearest nodes first.
        left = np.repeat(stop - each, count)
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        beta = np.zeros(len(self.chars) + len(words))
        nearest = left[order]
        edges = np.flatnonzero(np.r_[True, nearest[1:] != nearest[:-1], True]) if len(order) else []
        for low, high in zip(edges, edges[1:]):
            now = order[low:high]
            value, source = weight[now] + beta[self.to[now]], self.from_[now]
            groups = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            most = np.maximum.reduceat(value, groups)
            many = np.diff(np.r_[groups, len(now)])
            beta[source[groups]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, many)), groups))
        self.begin = begin
        self.log = np.minimum(weight + beta[self.to] - beta[self.from_], 0.0)
        self.total = np.cumsum(np.exp(self.log))
        degree = np.zeros(len(beta), np.int64)
        degree[each + word] = count
        self.first = np.r_[0, np.cumsum(degree)]
        self.before = np.r_[0.0, self.total][self.first]  # mass of all edges before each node's
        self.inside = np.r_[self.place, 0][self.first]
        with np.errstate(divide="ignore"):
            self.others = np.log(np.maximum(-np.expm1(self.log), 0.0))  # log mass of the other edges
        self.others[np.repeat(count == 1, count)] = -np.inf

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node."""
        low, high = self.first[node], self.first[node + 1] - 1
        edge = low.copy()
        many = np.flatnonzero(high > low)  # most characters inside a word have one way on
        before = self.before[node[many]]
        goal = before + u[many] * (self.before[node[many] + 1] - before)
        at, last = low[many], high[many]
        live = np.flatnonzero((self.total[at] <= goal) & (at < last))
        while len(live):  # a node has few edges
            at[live] += 1
            now = at[live]
            live = live[(self.total[now] <= goal[live]) & (now < last[live])]
        edge[many] = at
        return edge


@dataclass
class _Path:
    edges: np.ndarray  # of the whole text
    units: np.ndarray  # the word each edge belongs to
    own: int  # edges from here on are not shared with an earlier path
    value: float  # perturbed log probability
    logs: np.ndarray  # log probability before each edge
    rest: np.ndarray  # perturbed log mass of what else can follow each edge's start
    gone: dict[int, list[int]] = field(default_factory=dict)

    @property
    def log(self) -> float:
        return float(self.logs[-1])


def _units(text: str) -> list[str]:
    """Words with the spaces before them, but for the first of these. A space is put in front of the text, and no piece
    crosses a word's border."""
    units = text.split(" ")
    if "" not in units:
        return units
    out, spaces = [], ""
    for part in units:
        if part:
            out.append(spaces + part)
            spaces = ""
        else:
            spaces += " "
    return [*out, spaces[1:]] if spaces else out


def _below(log: np.ndarray | float, top: np.ndarray | float, u: np.ndarray | float):
    """Gumbel numbers at ``log`` that are at most ``top``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = log - np.log(np.exp(log - top) - np.log(u))
    return np.where(np.isneginf(log), -np.inf, np.minimum(out, top))


class Sampler:
    """Draws distinct segmentations of texts by a perturbed best-first search over their lattices."""

    def __init__(self, pieces: Pieces, k: int):
        self.pieces, self.k = pieces, k

    def _continue(self, lattice: Lattice, unit: np.ndarray, seeds: np.ndarray, places: np.ndarray, node: np.ndarray,
                  stop: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit, edge) of fresh paths from ``node`` to the end of each unit, in order."""
        where, edges = [], []
        live = np.flatnonzero(node != stop)
        node = node.copy()
        depth = 0
        while len(live):
            now = node[live]
            edge = lattice.draw(now, _mixed(_keys(seeds[live], stream, places[live] + lattice.inside[now])))
            where.append(live)
            edges.append(edge)
            node[live] = lattice.to[edge]
            live = live[node[live] != stop[live]]
            depth += 1
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, edge = np.concatenate(where), np.concatenate(edges)
        order = np.argsort(at, kind="stable")
        return unit[at[order]], edge[order]

    def _path(self, lattice: Lattice, seed: int, stream: int, units: np.ndarray, edges: np.ndarray, own: int,
              value: float, before: np.ndarray | None = None) -> _Path:
        logs = np.zeros(len(edges) + 1)
        np.cumsum(lattice.log[edges], out=logs[1:])
        rest = np.full(len(edges), -np.inf)
        others = lattice.others[edges[own:]]
        open_ = np.flatnonzero(others > -np.inf)  # where there is another way on
        place = open_ + own
        u = _mixed(_keys(np.array([seed], np.int64), stream, place))
        rest[place] = _below(logs[place] + others[open_], value, u)
        return _Path(edges, units, own, value, logs, rest)

    def batch(self, keys: list[int], documents: list[str]) -> Iterator[tuple[int, list[tuple[np.ndarray, float, float]]]]:
        """For each text in order: (its place, [(ids, log probability, inclusion score)])."""
        place_of: dict[str, int] = {}
        listed: list[int] = []
        counts = np.zeros(len(documents), np.int64)
        for n, text in enumerate(documents):
            units = _units(text)
            counts[n] = len(units)
            fresh = [u for u in dict.fromkeys(units) if u not in place_of]
            place_of.update(zip(fresh, range(len(place_of), len(place_of) + len(fresh))))
            listed.extend(map(place_of.__getitem__, units))
        words = np.array(listed, np.int64)
        lattice = Lattice(self.pieces, [" " + u for u in place_of])
        sizes = (lattice.end_node - lattice.start_node)[words]
        offset = np.cumsum(counts) - counts
        chars = np.cumsum(sizes) - sizes
        place = chars - np.repeat(chars[offset], counts)
        seeds = np.repeat(np.array(keys, np.int64), counts)
        unit = np.arange(len(words))
        unit_of, edge = self._continue(lattice, unit, seeds, place, lattice.start_node[words], lattice.end_node[words], 1)
        cuts = np.searchsorted(unit_of, np.r_[offset, len(words)])
        paths: list[list[_Path]] = []
        own_key = np.array(keys, np.int64)
        tops = -np.log(-np.log(_mixed(_keys(own_key, 0, np.zeros(1, np.int64)))))
        for n, (key, top) in enumerate(zip(keys, tops.tolist())):
            low, high = cuts[n], cuts[n + 1]
            paths.append([self._path(lattice, key, 1 << 20, unit_of[low:high], edge[low:high], 0, top)])
        for s in range(2, self.k + 1):
            picks = []
            turns = [_mixed(_keys(own_key, (2 << 20) + s, np.array([place]))) for place in (0, 1)]
            for n, known in enumerate(paths):
                best = max(known, key=lambda p: p.rest.max())
                at = int(best.rest.argmax())
                value = float(best.rest[at])
                if not np.isfinite(value):
                    continue
                source = lattice.from_[best.edges[at]]
                low, high = lattice.first[source], lattice.first[source + 1]
                gone = [int(best.edges[at]), *best.gone.get(at, [])]
                weight = np.exp(lattice.log[low:high])
                weight[np.array(gone) - low] = 0
                u = turns[0][n], turns[1][n]
                chosen = int(low + min(np.searchsorted(np.cumsum(weight), u[0] * weight.sum(), side="right"), high - low - 1))
                while weight[chosen - low] == 0:  # rounding at the upper end
                    chosen -= 1
                gone.append(chosen)
                best.gone[at] = gone[1:]
                with np.errstate(divide="ignore"):
                    left = np.log(max(0.0, weight.sum() - weight[chosen - low])) if len(gone) < high - low else -np.inf
                best.rest[at] = float(_below(np.float64(best.logs[at] + left), value, u[1]))
                picks.append((n, best, at, chosen, value))
            # What follows the new edges: the rest of their words, then all later words.
            parts, firsts = [], []
            for n, best, at, chosen, _ in picks:
                here = int(best.units[at])
                later = np.arange(here, offset[n] + counts[n])
                nodes = lattice.start_node[words[later]].copy()
                nodes[0] = lattice.to[chosen]
                parts.append(later)
                firsts.append(nodes)
            if not parts:
                break
            later, nodes = np.concatenate(parts), np.concatenate(firsts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            at_unit, more = self._continue(
                lattice, np.arange(len(later)), seeds[later], place[later], nodes, lattice.end_node[words[later]], s)
            bounds = np.searchsorted(owner[at_unit], np.arange(len(parts) + 1))
            for m, (n, best, at, chosen, value) in enumerate(picks):
                low, high = bounds[m], bounds[m + 1]
                units = np.concatenate([best.units[:at + 1], later[at_unit[low:high]]])
                edges = np.concatenate([best.edges[:at], [chosen], more[low:high]])
                paths[n].append(self._path(lattice, keys[n], (1 << 20) + s, units, edges, at + 1, value))
        for n, known in enumerate(paths):
            bar = max(float(p.rest.max()) for p in known)
            out = []
            for p in known:
                score = 1.0 if np.isneginf(bar) else float(-np.expm1(-np.exp(min(p.log - bar, 50.0))))
                out.append((self._ids(lattice, p.edges), p.log, score))
            yield n, out

    def _ids(self, lattice: Lattice, edges: np.ndarray) -> np.ndarray:
        ids = lattice.piece[edges]
        if (ids != NO_PIECE).all():
            return ids
        out = []
        for number, char in zip(ids.tolist(), lattice.chars[lattice.begin[edges]].tolist()):
            if number == NO_PIECE:
                out.extend(self.pieces.byte_ids[list(chr(char).encode("utf-8", "surrogatepass"))].tolist())
            else:
                out.append(number)
        return np.array(out, np.int32)


def _samples(batches: Iterator[pa.RecordBatch], pieces: Pieces, k: int):
    """(key, text, samples) of each row; lattices are built for about ``CHUNK_CHARS`` characters at once."""
    sampler = Sampler(pieces, k)
    for batch in batches:
        keys, held = [], []
        size = 0

        def flush():
            for n, found in sampler.batch([0 if x is None else x for x in keys], held):
                yield keys[n], held[n], found

        for key, text in zip(longs(batch, "id"), texts(batch)):
            keys.append(key)
            held.append(text)
            size += len(text)
            if size > CHUNK_CHARS:
                yield from flush()
                keys, held, size = [], [], 0
        if keys:
            yield from flush()


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def sample_segmentations(docs: DataFrame, k: int, pieces=Pieces.public, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sample, ids, log_prob, inclusion): up to ``k`` distinct segmentations of each text, drawn without replacement.

    A segmentation's probability is the product of its pieces' weights, over that of all segmentations. The text's
    log mass gets a Gumbel number; the search goes down the lattice, where the best branch keeps the number of its
    parent and all others share one drawn below it; the branch of the largest number is opened next. So the
    segmentations found first are the k largest of all perturbed log probabilities. ``inclusion`` is the probability
    of a segmentation to be above the largest number that was left (1 if none was). Numbers come from the row's key
    and the place in the text, so a row gives the same samples in any partition.

    Words are independent, as no piece crosses a space, so their lattices are built once for each word of a chunk. A
    space is put in front of the text. Characters without a piece are spelled in bytes; U+2581 too, so decoding gives
    the text back. Null and empty texts have one segmentation, of the space in front. A text with fewer than ``k``
    segmentations gives all of them. A null key counts as 0. Repeated rows repeat their samples.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        for key, _, found in _samples(batches, pieces(), k):
            yield {"id": [key] * len(found), "sample": list(range(1, len(found) + 1)), "ids": [i.tolist() for i, _, _ in found],
                   "log_prob": [p for _, p, _ in found], "inclusion": [q for _, _, q in found]}

    return map_batches(_narrow(docs, id_col, text_col), work,
                       "id bigint, sample int, ids array<int>, log_prob double, inclusion double")


def sample_digests(docs: DataFrame, k: int, pieces=Pieces.public, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``sample_segmentations``, with the number and crc32 of the ids in their place, and whether decoding gives
    the text back."""

    def work(batches: Iterator[pa.RecordBatch]):
        vocabulary = pieces()
        names = ("doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "inclusion", "round_trip")
        out: dict[str, list] = {c: [] for c in names}
        for key, text, found in _samples(batches, vocabulary, k):
            for n, (ids, log, inclusion) in enumerate(found, 1):
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                for name, value in zip(names, (key, n, len(ids), crc, log, inclusion, vocabulary.decode(ids) == text)):
                    out[name].append(value)
            if len(out["doc_id"]) > 4000:
                yield out
                out = {c: [] for c in names}
        yield out

    return map_batches(_narrow(docs, id_col, text_col), work, "doc_id bigint, sample int, n_pieces int, ids_crc32 bigint, "
                                                              "log_prob double, inclusion double, round_trip boolean")


def decode(encoded: DataFrame, pieces=Pieces.public, ids_col: str = "ids") -> DataFrame:
    """Add ``text``: the decoded ids. Null ids give a null text; a clashing ``text`` column is replaced."""

    @F.udf("string", useArrow=True)
    def to_text(ids):
        if not hasattr(to_text, "pieces"):
            to_text.pieces = pieces()
        return None if ids is None else to_text.pieces.decode(np.asarray(ids, np.int64))

    return encoded.withColumn("text", to_text(F.col(ids_col)))
