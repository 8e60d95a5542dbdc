"""Periodic runs of words, by an online sparse diagonal DP.

A diagonal is a lag: words i and i - lag. Its match length grows by one while they are equal and the
diagonal ends where they differ; ``period + match length`` words then form a stretch with that
period. A run has at least three periods and 24 words, so its diagonal matches at least
twice the period, and never less than ``SEED`` words. So an earlier occurrence of a word
counts only where the words before it match as well: ``SEED`` of them for
periods up to ``SEED``, and 2, 4, 8 ... times as many for periods up to that number. Of these
occurrences the nearest is enough. In a run with smallest period p each stretch of p words or more
occurs next p words later, never earlier, or the run had a smaller period. So every word has one
active lag per level, work is n log n for any text, and a run is exactly one unbroken
sequence of words with the same nearest lag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qloom.llm.common import documents_of, text_chunks
from qloom.llm.words import SPACES, Hasher, find_words, mix

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The shortest match of a diagonal that gives a run: min over p of max(2 p, 24 - p).
SEED = 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id bigint, n_words bigint, runs {RUNS}, n_kept bigint, collapsed_sha256 string"


def nearest_lags(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each gram the distance to the nearest earlier equal one; 0 where there is none.
    ``at`` are the ascending positions of the grams."""
    order = np.argsort(grams, kind="stable")
    sorted_grams, sorted_at = grams[order], at[order]
    lags = np.zeros(len(grams), np.int64)
    same = sorted_grams[1:] == sorted_grams[:-1]
    lags[order[1:][same]] = (sorted_at[1:] - sorted_at[:-1])[same]
    return lags


def find_runs(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(row, start, length, period) of all runs in the texts of a chunk, by row, start, period.

    ``words`` are the word hashes of all texts, ``rows`` the first word of each (one entry
    more than texts). Starts count within the text.
    """
    n = len(words)
    none = np.zeros((0, 4), np.int64)
    if n < LEAST_WORDS:
        return none
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    # Grams of a text never equal those of another one, so lags stay within texts.
    grams = mix(words + mix(owner.astype(np.uint64)))
    at = np.arange(n)
    size = 1
    while size < SEED:
        grams, at = _doubled(grams, at, size, owner)
        size *= 2
    found = []
    while len(at):
        lags = nearest_lags(grams, at)
        shortest = 0 if size == SEED else size // 2
        active = np.flatnonzero((lags > shortest) & (lags <= size))
        if len(active):
            # A diagonal goes on while the next word has the same lag; where it ends, its match
            # length is known, and the run is emitted.
            here, lag = at[active], lags[active]
            opens = np.flatnonzero(
                np.concatenate(([True], (here[1:] != here[:-1] + 1) | (lag[1:] != lag[:-1])))
            )
            last = np.append(opens[1:], len(here)) - 1
            period = lag[opens]
            match = here[last] - here[opens] + size
            start = here[opens] - size + 1 - period
            length = match + period
            enough = (length >= LEAST_PERIODS * period) & (length >= LEAST_WORDS)
            text = owner[here[opens]]
            found.append(np.stack((text, start - rows[text], length, period), 1)[enough])
        # A longer gram repeats only where its last words do, at this size.
        again = _repeated(grams)
        grams, at = _doubled(grams[again], at[again], size, owner, at, grams)
        size *= 2
    runs = np.concatenate(found) if found else none
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _repeated(grams: np.ndarray) -> np.ndarray:
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    out = np.zeros(len(grams), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _doubled(grams, at, size, owner, all_at=None, all_grams=None):
    """Grams of twice the size that end at ``at``, where they fit into their text."""
    all_at = at if all_at is None else all_at
    all_grams = grams if all_grams is None else all_grams
    before = np.searchsorted(all_at, at - size)
    before[before == len(all_at)] = 0
    fits = (at >= size) & (all_at[before] == at - size)
    fits &= owner[np.maximum(at - size, 0)] == owner[at]
    before, at = before[fits], at[fits]
    return mix(mix(all_grams[before]) + grams[fits]), at


def rotated(first: np.ndarray, rows: np.ndarray, ids: list) -> np.ndarray:
    """Word numbers after the periodic ending that some ids call for: with h = crc32 of the id in
    decimal and g = h // 10, texts with h % 10 = 0 repeat p words from word a on."""
    for k, doc_id in enumerate(ids):
        n = int(rows[k + 1] - rows[k])
        if doc_id is None or n == 0:
            continue
        g, rest = divmod(crc32(str(doc_id).encode()), 10)
        if rest:
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i = np.arange(a, n)
        first[rows[k] + a : rows[k + 1]] = rows[k] + a + (i - a) % p
    return first


def dropped_words(runs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of words that some run holds behind its first period."""
    depth = np.zeros(int(rows[-1]) + 1, np.int64)
    first = rows[runs[:, 0]] + runs[:, 1]
    np.add.at(depth, first + runs[:, 3], 1)
    np.add.at(depth, first + runs[:, 2], -1)
    return np.cumsum(depth[:-1]) > 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, a space behind each, and where each begins (one entry more than words)."""
    lengths = ends - starts + 1
    begins = np.concatenate(([0], np.cumsum(lengths)))
    index = np.arange(begins[-1]) + np.repeat(starts - begins[:-1], lengths)
    out = np.append(data, np.uint8(32))[index]
    out[begins[1:] - 1] = 32
    return out.tobytes(), begins


def periodic_runs(docs: DataFrame, rotate: bool = False) -> DataFrame:
    """Runs of every text, and the text with repeats taken out.

    Words are ``[^\\x20\\x09-\\x0D]+``, as they stand. A run is a stretch of words with smallest
    period q and at least ``max(24, 3 q)`` words that no neighbouring word extends. Returns
    one row per input row: doc_id, n_words, runs (start, length, period; by start, then
    period), n_kept (words outside all runs' repeats), collapsed_sha256 (of the kept words,
    joined by one space). ``rotate`` first gives the texts that ``rotated`` names a periodic ending.

    NULL and empty texts have no words, no runs and the hash of the empty text. Repeated rows give
    repeated rows; a NULL doc_id stays NULL and is never rotated; an empty table gives an empty table;
    other columns are ignored. Texts are cut into chunks of whole rows, and a text of any length
    takes n log n steps. Words are told apart by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            words_of, kept_of, hashes, parts = [], [], [], []
            for first, end, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, SPACES)
                rows = words.rows
                order = np.arange(len(words.starts))
                if rotate:
                    order = rotated(order, rows, ids[first:end])
                found = hasher.ranges(hasher.prefix(data), words.starts, words.ends)
                runs = find_runs(found[order], rows)
                stays = ~dropped_words(runs, rows)
                kept_rows = np.concatenate(([0], np.cumsum(stays)))[rows]
                kept = order[stays]
                text, begins = joined_words(data, words.starts[kept], words.ends[kept])
                cuts = begins[kept_rows]
                for k in range(end - first):
                    low, high = int(cuts[k]), int(cuts[k + 1])
                    hashes.append(hashlib.sha256(text[low : max(low, high - 1)]).hexdigest())
                words_of.append(np.diff(rows))
                kept_of.append(np.diff(kept_rows))
                counts = np.bincount(runs[:, 0], minlength=end - first)
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                cells = pa.StructArray.from_arrays(
                    [pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"]
                )
                parts.append(pa.ListArray.from_arrays(ends, cells))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words_of, kept_of)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(flat[0], pa.int64()),
                    pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind),
                    pa.array(flat[1], pa.int64()),
                    pa.array(hashes, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "n_kept", "collapsed_sha256"],
            )

    return documents_of(docs).mapInArrow(run, SCHEMA)
