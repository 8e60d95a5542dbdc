from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from qloom.llm.packing import OpenBins, pack
from qloom.llm.suite import word_vocabulary
from qloom.llm.tokens import PreTokens, count_tokens, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture
def texts(odd, prose):
    rng = random.Random(4)
    letters = "abTS'’ \n\t!?.,1²½éÉßñİΣςσ中ȺȾ\u0301\u0085\u00a0"
    noise = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [*odd, *noise, *(prose(k, 10 + 40 * (k % 60)) for k in range(60)), "We'll say <|startoftext|> 'LL"]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(library, texts):
    own = PreTokens(vocabulary(word_vocabulary()))
    given = [np.frombuffer(b, "<u4").tolist() for b in own.ids([t or "" for t in texts])]
    assert given == [ids_of(library, t) for t in texts]


def test_every_plain_code_point(library):
    own = PreTokens(vocabulary(word_vocabulary()))
    texts = [t for c in map(chr, range(0x300)) for t in (c, f"a{c}b", f"{c}{c}'s {c}'", f"1{c}2")]
    given = [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)]
    assert given == [ids_of(library, t) for t in texts]


def test_counts(documents, library, texts, monkeypatch):
    # A small table of common pre-tokens, so most go through the join.
    monkeypatch.setattr("qloom.llm.tokens.COMMON_ENTRIES", 20)
    docs = documents(texts)
    rows = {r.doc_id: r for r in count_tokens(docs, word_vocabulary(), limit=50).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        n = len(ids_of(library, text))
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((text or "").encode()), n, n > 50)
    assert count_tokens(documents([]), word_vocabulary()).collect() == []
    assert count_tokens(docs.limit(5).union(docs.limit(5)), word_vocabulary()).count() == 10


def check_packing(rows, expected, capacity):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    return len(sequences)


def test_pack(documents, library, texts):
    capacity, expected = 128, {}
    for k, text in enumerate(texts):
        ids = [*ids_of(library, text), 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            expected[k, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    rows = pack(documents(texts), word_vocabulary(), capacity).collect()
    used = check_packing(rows, expected, capacity)
    least = -(-sum(n for _, n, _ in expected.values()) // capacity)
    assert used <= 1.02 * least + 1


def test_pack_nothing(documents):
    assert pack(documents([]), word_vocabulary()).collect() == []


def test_sum_of_squares_rule():
    """Each placement is the one of the smallest sum of squared counts."""
    rng = random.Random(1)
    bins, gaps = OpenBins(20), {}
    for _ in range(400):
        size = rng.randint(1, 20)

        def total(change):
            counts = defaultdict(int)
            for g in gaps.values():
                counts[g] += 1
            for g, by in change:
                counts[g] += by
            return sum(n * n for g, n in counts.items() if g)

        options = [total([(g, -1), (g - size, 1)]) for g in set(gaps.values()) if g >= size]
        options.append(total([(20 - size, 1)]))
        number, offset = bins.place(size)
        assert offset == 20 - gaps.get(number, 20)
        gaps[number] = gaps.get(number, 20) - size
        assert total([]) == min(options)
