from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import random

import numpy as np
import pytest

from qloom.llm.decontam import Index, drop_contaminated, edited, find_passages, most_edits, prefix_distance, word_hashes
from qloom.llm.words import Hasher


def distance(a, b):
    """Smallest edit distance of ``a`` to a beginning of ``b``."""
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        last, row = row, [k]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 80))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        bits = {}
        for k, x in enumerate(a):
            bits[x] = bits.get(x, 0) | 1 << k
        most, exact = len(a) // 3, distance(a, b)
        got, used = prefix_distance(bits, len(a), b, most)
        assert (got == exact) if exact <= most else got > most
        if exact <= most:
            assert distance(a, b[:used]) == exact


@pytest.fixture
def bench(spark, prose):
    items = [prose(1000 + k, 12 + k) for k in range(24)]
    rows = [(k, t, "x") for k, t in enumerate(items)] + [(90, None, "x"), (91, "too short", "x"), (92, items[0], "x")]
    return items, spark.createDataFrame(rows, "item_id int, text string, doc_id string")


def planted(prose, items):
    rng = np.random.default_rng(3)
    texts, truth = [], set()
    for k in range(60):
        number = k % len(items)
        words = items[number].split()
        ids = np.arange(len(words)).astype(np.uint64)
        edits = most_edits(len(words), 0.2) if k >= 24 else 0
        changed = [words[int(i)] if i < len(words) else f"new{i}" for i in edited(ids, edits, rng)]
        texts.append(f"{prose(k, 50)} {' '.join(changed).upper() if k % 5 == 0 else ' '.join(changed)}, {prose(k + 500, 40)}")
        truth |= {(k, number), (k, 92)} if number == 0 else {(k, number)}
    return texts, truth


def test_finds_what_is_planted(documents, prose, bench, odd):
    items, benchmark = bench
    texts, truth = planted(prose, items)
    rows = find_passages(documents([*texts, *odd, *(prose(k + 9000, 80) for k in range(30))]), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found <= truth and len(found) >= 0.97 * len(truth)
    assert {(k, i) for k, i in truth if k < 24} <= found
    for r in rows:
        if r.doc_id < 24 and r.item_id != 92:
            assert r.distance == 0
            assert texts[r.doc_id][r.start : r.end].lower().rstrip(".") == items[r.item_id].lower().rstrip(".")


def test_all_windows_by_brute_force(prose):
    """Every window within the edit distance is found, and no other."""
    rng = np.random.default_rng(7)
    items = [rng.integers(50, size=n).astype(np.uint64) for n in (9, 12, 20)]
    index = Index([], [])
    index.items = []
    texts = []
    for k in range(80):
        item = items[k % 3]
        texts.append(np.concatenate((rng.integers(1000, 2000, size=10).astype(np.uint64), edited(item, k % 4, rng), rng.integers(1000, 2000, size=10).astype(np.uint64))))
    truth = {
        (k, n)
        for k, t in enumerate(texts)
        for n, item in enumerate(items)
        if min(distance(item.tolist(), t[s:].tolist()) for s in range(len(t))) <= most_edits(len(item), 0.2)
    }
    words = [" ".join(f"w{int(x)}" for x in item) for item in items]
    built = Index([0, 1, 2], words)
    from qloom.llm.decontam import word_hashes
    from qloom.llm.words import Hasher

    found = set()
    for k, t in enumerate(texts):
        hashes = word_hashes(" ".join(f"w{int(x)}" for x in t), Hasher())
        found |= {(k, number) for _, number, *_ in built.matches(hashes, np.array([0, len(hashes)]))}
    assert found <= truth and len(found) >= 0.97 * len(truth)


def test_blocks_and_filter(documents, prose, bench):
    items, benchmark = bench
    texts, truth = planted(prose, items)
    docs = documents([*texts, None, ""])
    one = {tuple(r) for r in find_passages(docs, benchmark).collect()}
    assert {tuple(r) for r in find_passages(docs, benchmark, block_items=5).collect()} == one
    kept = drop_contaminated(docs, benchmark, block_items=10)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(62)) - {k for k, *_ in one}


def test_nothing(documents, bench):
    _, benchmark = bench
    assert find_passages(documents([]), benchmark).collect() == []
    assert find_passages(documents(["a b c d e f g h"]), benchmark.limit(0)).collect() == []


def test_what_tasks_get_names_no_class_of_the_package(prose):
    import pickle
    import pickletools

    texts = [prose(k, 20) for k in range(6)]
    built = Index(list(range(6)), texts)
    sent = pickle.dumps(built.state(), 4)
    named = {str(arg) for _, arg, _ in pickletools.genops(sent) if isinstance(arg, str)}
    assert not any("qloom" in name for name in named)
    again = Index.of(pickle.loads(sent))
    hashes = word_hashes(prose(99, 30) + " " + texts[2] + " " + prose(98, 30), Hasher())
    rows = np.array([0, len(hashes)])
    assert list(again.matches(hashes, rows)) == list(built.matches(hashes, rows)) != []
