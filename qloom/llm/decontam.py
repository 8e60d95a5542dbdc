"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, keep_rows, text_chunks
from qloom.llm.words import NOT_ALNUM, Hasher, Words, find_words, mix, seeded

#: Items searched for in one pass; more go in blocks of this size, a pass each.
BLOCK_ITEMS = 20_000
SHORTEST = 5
EDIT_SHARE = 0.2
SAMPLED = 3
PER_WALK = 4
TARGET_RECALL = 0.99
MOST_WALKS = 16
WINDOWS = 4096
CHUNK = 1 << 21
PAD = np.uint64(0x5851F42D4C957F2D)

HITS = "doc_id bigint, item_id bigint, distance int, item_words int, start bigint, `end` bigint"


def most_edits(words: int, share: float) -> int:
    return int(words * share)


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of lower-cased text: runs of letters and digits; general punctuation separates."""
    wide = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80))
    if len(wide):
        data = data.copy()
        for k in range(3):
            data[wide + k] = 0x20
    return find_words(data, offsets, NOT_ALNUM)


def word_hashes(text: str, hasher: Hasher) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    words = split(data, np.array([0, len(data)]))
    return hasher.ranges(hasher.prefix(data), words.starts, words.ends)


class Embedding:
    """Random walks of the CGK embedding, and the samples each repetition takes of it.

    A walk reads a symbol per step, writes it to the embedding and moves on or stays, as a
    hash of step and symbol says; behind the end of the string it writes padding. A
    string of n symbols has 3 n steps. Repetitions sample ``SAMPLED`` positions each.
    """

    def __init__(self, walks: int, seed: int = 1) -> None:
        self.walks, self.seed = walks, seed
        self.samples: dict[int, np.ndarray] = {}

    def sampled(self, length: int) -> np.ndarray:
        """(walk, repetition, sample) positions for strings of ``length``."""
        if length not in self.samples:
            rng = np.random.default_rng([self.seed, length])
            drawn = [rng.choice(3 * length, SAMPLED, replace=False) for _ in range(self.walks * PER_WALK)]
            self.samples[length] = np.array(drawn, np.int64).reshape(self.walks, PER_WALK, SAMPLED)
        return self.samples[length]

    def keys(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(strings, repetitions) keys of the strings ``symbols[start:end]``, taken as
        strings of ``lengths``, with padding where they end before."""
        out = np.empty((len(starts), self.walks * PER_WALK), np.uint64)
        padded = np.append(symbols, PAD)
        for low in range(0, len(starts), WINDOWS):
            part = slice(low, low + WINDOWS)
            own, which = np.unique(lengths[part], return_inverse=True)
            steps = 3 * int(own[-1])
            samples = np.stack([self.sampled(int(n)) for n in own])
            written = np.empty((steps, len(which)), np.uint64)
            columns = np.arange(len(which))
            for w in range(self.walks):
                at, end = starts[part].copy(), ends[part]
                for j in range(steps):
                    written[j] = padded[np.where(at < end, at, len(symbols))]
                    at += (seeded(written[j], w * 4099 + j) >> np.uint64(63)).astype(np.int64)
                for g in range(PER_WALK):
                    key = mix((lengths[part] * self.walks * PER_WALK + w * PER_WALK + g).astype(np.uint64))
                    for position in samples[which, w, g].T:
                        key = mix(key + written[position, columns])
                    out[part, w * PER_WALK + g] = key
        return out


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item after random substitutions, insertions and deletions."""
    out = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(out) + 1)), int(rng.integers(3))
        fresh = int(rng.integers(1 << 63))
        if kind == 0 and at < len(out):
            out[at] = fresh
        elif kind == 1 and at < len(out) and len(out) > 1:
            del out[at]
        else:
            out.insert(at, fresh)
    return np.array(out, np.uint64)


def walks_needed(lengths: list[int], share: float, target: float = TARGET_RECALL) -> int:
    """Walks that find a string at half to all of the allowed edits with the target
    chance, measured on random strings of these lengths."""
    rng = np.random.default_rng(5)
    items, windows = [], []
    for length in lengths * math.ceil(400 / len(lengths)):
        item = rng.integers(1 << 63, size=length).astype(np.uint64)
        most = most_edits(length, share)
        other = edited(item, int(rng.integers((most + 1) // 2, most + 1)), rng)
        # The window is item-sized: cut, or filled with what follows the passage.
        items.append(item)
        windows.append(np.concatenate((other, rng.integers(1 << 63, size=length).astype(np.uint64)))[:length])
    sizes = np.array([len(i) for i in items])
    ends = np.cumsum(sizes)
    drawn = Embedding(MOST_WALKS)
    same = drawn.keys(np.concatenate(items), ends - sizes, ends, sizes) == drawn.keys(
        np.concatenate(windows), ends - sizes, ends, sizes
    )
    for walks in range(2, MOST_WALKS):
        if same[:, : walks * PER_WALK].any(1).mean() >= target:
            return walks
    return MOST_WALKS


def prefix_distance(positions: dict[int, int], length: int, text: list[int], most: int) -> tuple[int, int]:
    """(smallest edit distance of a string to a beginning of ``text``, length of that
    beginning), bit-parallel; ``positions`` has per symbol the bits where the string
    has it. Distances above ``most`` come back as ``most + 1``."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, at = (length, 0) if length <= most else (most + 1, 0)
    for column, symbol in enumerate(text, 1):
        equal = positions.get(symbol, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if score < best:
            best, at = score, column
    return best, at


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(mix(hashes[:-1]) + hashes[1:])


class Index:
    """Items of one block, by length."""

    def __init__(self, ids: list[int], texts: list[str], share: float = EDIT_SHARE, shortest: int = SHORTEST) -> None:
        hasher = Hasher()
        self.share = share
        self.hasher = Hasher()
        self.items = [(k, word_hashes(t or "", hasher)) for k, t in zip(ids, texts)]
        self.items = [(k, w) for k, w in self.items if len(w) >= shortest]
        self.bits: list[dict[int, int]] = []
        by_length: dict[int, list[int]] = {}
        for number, (_, words) in enumerate(self.items):
            bits: dict[int, int] = {}
            for k, word in enumerate(words.tolist()):
                bits[word] = bits.get(word, 0) | 1 << k
            self.bits.append(bits)
            by_length.setdefault(len(words), []).append(number)
        self.lengths = np.array(sorted(by_length), np.int64)
        pairs = [pairs_of(w) for _, w in self.items]
        self.vocabulary = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        each = [np.unique(p, return_counts=True) for p in pairs]
        # Entry -1 of these tables stands for pairs of no item.
        self.twice = np.zeros(len(self.vocabulary) + 1, bool)
        self.of_lengths = np.zeros(len(self.vocabulary) + 1, np.uint64)
        for (found, times), (_, words) in zip(each, self.items):
            places = np.searchsorted(self.vocabulary, found)
            self.twice[places[times > 1]] = True
            self.of_lengths[places] |= np.uint64(1 << len(words) % 64)
        # A table of hash prefixes tells most word pairs that no item has.
        self.bits_of_table = max(20, min(26, 3 + len(self.vocabulary).bit_length()))
        self.seen = np.zeros(1 << self.bits_of_table, bool)
        self.seen[self._prefix(self.vocabulary)] = True
        self.embedding = Embedding(walks_needed(self.lengths.tolist(), share) if pairs else 0)
        symbols = np.concatenate([w for _, w in self.items]) if pairs else np.zeros(0, np.uint64)
        sizes = np.array([len(w) for _, w in self.items], np.int64)
        ends = np.cumsum(sizes)
        keys = self.embedding.keys(symbols, ends - sizes, ends, sizes)
        numbers = np.repeat(np.arange(len(self.items)), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.numbers = keys.ravel()[order], numbers[order]

    def state(self) -> dict:
        """What a task needs to search, as arrays, lists and numbers only: a broadcast names
        the classes of its objects, and executors may lack this package."""
        kept = {name: value for name, value in vars(self).items() if name not in ("hasher", "embedding")}
        return {**kept, "walks": self.embedding.walks, "seed": self.embedding.seed, "samples": self.embedding.samples}

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        vars(index).update(state)
        index.hasher, index.embedding = Hasher(), Embedding(state["walks"], state["seed"])
        index.embedding.samples = dict(state["samples"])
        return index

    def _prefix(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits_of_table)).astype(np.int64)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Position of each word pair in the items' vocabulary, -1 for others."""
        out = np.full(len(pairs), -1, np.int32)
        where = np.flatnonzero(self.seen[self._prefix(pairs)])
        found = np.searchsorted(self.vocabulary, pairs[where])
        found[found == len(self.vocabulary)] = 0
        out[where] = np.where(self.vocabulary[found] == pairs[where], found, -1)
        return out

    def windows(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, lengths) of the item-sized windows that can match.

        An edit takes at most two of the n - 1 word pairs of an item away, so a
        window with fewer than n - 1 - 2 edits pairs of items holds no match. A pair that no
        item has twice counts once. That is asked first of running counts, which leave
        repeats out that follow each other, but for one at the start, and then exactly, of
        the pairs that items of the window's length have.
        """
        ranks = self.ranks(pairs_of(hashes))
        counted = ranks >= 0
        counted[1:] &= (ranks[1:] != ranks[:-1]) | self.twice[ranks[1:]]
        counts = np.zeros(len(hashes) + 1, np.int32)
        np.cumsum(counted, out=counts[1 : len(hashes)])
        counts[len(hashes)] = counts[len(hashes) - 1]
        last = np.repeat(rows[1:], np.diff(rows))
        at = np.arange(len(hashes))
        starts, lengths = [], []
        for length in self.lengths.tolist():
            ends = np.minimum(at + length, last) - 1
            least = length - 1 - 2 * most_edits(length, self.share)
            starts.append(np.flatnonzero(counts[ends] - counts[:-1] >= least - 1))
            lengths.append(np.full(len(starts[-1]), length))
        first, size = np.concatenate(starts), np.concatenate(lengths)
        ends = np.minimum(first + size, last[first])
        least = size - 1 - 2 * (size * self.share).astype(np.int64)
        ranks = np.append(ranks, np.int32(-1))
        keep = np.zeros(len(first), bool)
        for low in range(0, len(first), WINDOWS):
            part = slice(low, low + WINDOWS)
            places = first[part, None] + np.arange(int(size[part].max()) - 1)
            held = np.sort(ranks[np.where(places < ends[part, None] - 1, places, len(ranks) - 1)], 1)
            fresh = np.ones(held.shape, bool)
            fresh[:, 1:] = (held[:, 1:] != held[:, :-1]) | self.twice[held[:, 1:]]
            of_length = self.of_lengths[held] >> (size[part, None] % 64).astype(np.uint64) & np.uint64(1)
            keep[part] = (fresh & (of_length > 0)).sum(1) >= least[part]
        return first[keep], ends[keep], size[keep]

    def matches(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, end word): the best place of an item in a row."""
        if not self.items or len(hashes) < 2:
            return
        starts, ends, sizes = self.windows(hashes, rows)
        if not len(starts):
            return
        # Equal windows, with what verification reads behind them, are embedded and verified once.
        row = np.searchsorted(rows, starts, side="right") - 1
        behind = np.minimum(starts + sizes + (sizes * self.share).astype(np.int64), rows[row + 1])
        content = self.hasher.ranges(self.hasher.prefix(hashes), starts, behind) ^ seeded(sizes.astype(np.uint64), 11)
        _, first, which = np.unique(content, return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(first) + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, number in self.candidates(hashes, starts[first], ends[first], sizes[first]):
            at, length = int(starts[first[k]]), len(self.items[number][1])
            text = hashes[at : int(behind[first[k]])].tolist()
            distance, used = prefix_distance(self.bits[number], length, text, most_edits(length, self.share))
            if distance > most_edits(length, self.share):
                continue
            for place in order[bounds[k] : bounds[k + 1]].tolist():
                value = (distance, int(starts[place]), int(starts[place]) + used)
                spot = int(row[place]), number
                best[spot] = min(value, best.get(spot, value))
        for (where, number), (distance, start, end) in sorted(best.items()):
            yield where, number, distance, start, end

    def candidates(
        self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray
    ) -> list[tuple[int, int]]:
        """(window, item) that share a key and are of one length."""
        found = self.embedding.keys(hashes, starts, ends, sizes)
        low = np.searchsorted(self.keys, found.ravel(), side="left")
        high = np.searchsorted(self.keys, found.ravel(), side="right")
        hit = np.flatnonzero(high > low)
        return sorted({(int(k // found.shape[1]), int(n)) for k in hit for n in self.numbers[low[k] : high[k]]})


def find_passages(
    docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Documents that hold a benchmark item, or a passage within an edit distance of
    ``share`` of the item's words.

    Returns a row per document and item: doc_id, item_id, distance (word edits),
    item_words, start and end of the best place in code points; documents without
    a passage have no row. Words are lower-cased runs of letters and digits. NULL and empty
    texts hold nothing; items of fewer than ``SHORTEST`` words are not
    searched; equal items are found each for itself, repeated rows give repeated
    results; empty tables give an empty table; other columns are ignored.

    Every item-sized window of every text that has enough word pairs of the items is
    embedded by random walks and compared with the items by repeated samples
    of the embedding; the repetitions follow from the recall measured on edited
    strings. Candidates are verified by exact edit distance. The
    items of one block are broadcast; a larger benchmark is searched in blocks.
    """
    found = [_search(docs, shared) for shared in broadcast_blocks(docs, benchmark, share, block_items)]
    return reduce(DataFrame.unionByName, found)


def broadcast_blocks(docs: DataFrame, benchmark: DataFrame, share: float, block_items: int) -> Iterator:
    """The index of each block of items, broadcast."""
    wanted = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text IS NOT NULL")
    blocks = max(1, math.ceil(wanted.count() / block_items))
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        index = Index(part.column("item_id").to_pylist(), part.column("text").to_pylist(), share)
        yield docs.sparkSession.sparkContext.broadcast(index.state())


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item as ``find_passages`` finds it."""
    for shared in broadcast_blocks(docs, benchmark, share, block_items):
        docs = keep_rows(docs, _free_of(shared))
    return docs


def _free_of(shared):
    def decide():
        index, hasher = Index.of(shared.value), Hasher()

        def approve(texts: pa.Array) -> np.ndarray:
            good = np.ones(len(texts), bool)
            for first, _, data, offsets in text_chunks(pc.utf8_lower(texts), CHUNK):
                words = split(data, offsets)
                hashes = hasher.ranges(hasher.prefix(data), words.starts, words.ends)
                for row, *_ in index.matches(hashes, words.rows):
                    good[first + row] = False
            return good

        return approve

    return decide


def _search(docs: DataFrame, shared) -> DataFrame:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = Index.of(shared.value), Hasher()
        for batch in batches:
            lower = pc.utf8_lower(batch.column("text"))
            columns: list[list[int]] = [[] for _ in range(6)]
            ids = batch.column("doc_id")
            for first, _, data, offsets in text_chunks(lower, CHUNK):
                words = split(data, offsets)
                hashes = hasher.ranges(hasher.prefix(data), words.starts, words.ends)
                for row, number, distance, start, end in index.matches(hashes, words.rows):
                    begin = int(offsets[row])
                    low, high = int(words.starts[start]), int(words.ends[end - 1])
                    values = (
                        ids[first + row].as_py(),
                        index.items[number][0],
                        distance,
                        len(index.items[number][1]),
                        len(data[begin:low].tobytes().decode()),
                        len(data[begin:high].tobytes().decode()),
                    )
                    for column, value in zip(columns, values):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "item_id", "distance", "item_words", "start", "end"],
            )

    return documents_of(docs).mapInArrow(search, HITS)
