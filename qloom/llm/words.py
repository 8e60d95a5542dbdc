"""Words of many texts at once, as 64-bit hashes, by array operations on UTF-8 bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(BASE, -1, 1 << 64)


def separators(other: str = "") -> np.ndarray:
    """Table of bytes that separate words: white space and ``other``."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    table[list(other.encode("ascii"))] = True
    return table


SPACES = separators()
#: Everything in ASCII but letters and digits; other characters belong to words.
NOT_ALNUM = separators("".join(chr(b) for b in range(128) if not chr(b).isalnum()))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """One of a family of hash functions of ``x``."""
    return mix(x + np.uint64((seed * BASE + 0x632BE59BD9B4E019) % (1 << 64)))


class Words(NamedTuple):
    """Words of the rows of a chunk: byte ranges, and the first word of each row
    (one entry more than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = ~table[data]
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


class Hasher:
    """Hashes of byte ranges by prefix sums of a polynomial; powers are kept."""

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self._powers) < len(data) + 1:
            n = len(data) + 1
            for name, base in (("_powers", BASE), ("_inverse", _UNBASE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        sums = np.zeros(len(data) + 1, np.uint64)
        # One is added to every byte, so leading zero bytes count.
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self._inverse[starts])


def sentence_starts(
    data: np.ndarray, words: Words, hashes: np.ndarray, longest: int = 40, spacing: int = 16
) -> np.ndarray:
    """Flags of words that open a sentence: the first of a row, and those with
    ``. ! ?`` or a line break before them. Sentences of more than ``longest``
    words open new ones where the hash of a word says so, on average every
    ``spacing`` words, so that equal passages are cut alike wherever they stand."""
    n = len(words.starts)
    flags = np.zeros(n, bool)
    if not n:
        return flags
    stop = np.zeros(256, bool)
    stop[list(b".!?\n\r")] = True
    stops = np.flatnonzero(stop[data])
    # A stop at byte p opens a sentence at the first word that starts behind p.
    following = np.searchsorted(words.starts, stops, side="right")
    flags[following[following < n]] = True
    first = words.rows[:-1]
    flags[first[first < n]] = True
    opened = np.flatnonzero(flags)
    lengths = np.diff(np.append(opened, n))
    long = np.repeat(lengths > longest, lengths)
    flags |= long & (seeded(hashes, 977) % np.uint64(spacing) == 0)
    return flags
