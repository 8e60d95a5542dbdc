from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import random

import numpy as np

from qloom.llm.components import connected_components
from qloom.llm.near import BINS, Densifier, band_keys, near_duplicates, sketch
from qloom.llm.words import mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute(texts, size=2, percent=80):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [(k, len(sets[k]), find(k), find(k) == k) for k in range(len(texts))]


def collect(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_copies(prose, groups=12, copies=9):
    rng = random.Random(8)
    texts = []
    for g in range(groups):
        words = prose(g, rng.choice([12, 40, 150])).split()
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.randint(0, len(words) // 12)):
                changed[rng.randrange(len(changed))] = f"w{rng.random()}"
            texts.append(" ".join(changed))
            words = changed if rng.random() < 0.5 else words
    return texts


def test_against_all_pairs(documents, prose, odd):
    texts = [*odd, *near_copies(prose), "A b", "a  B", "b a"]
    assert collect(near_duplicates(documents(texts))) == brute(texts)


def test_five_words(documents, prose):
    texts = near_copies(prose, 6, 6)
    assert collect(near_duplicates(documents(texts), 5)) == brute(texts, 5)


def test_nothing_and_repeated_rows(documents):
    assert near_duplicates(documents([])).collect() == []
    docs = documents(["a b c", None])
    assert collect(near_duplicates(docs.union(docs))) == brute(["a b c", None])[:1] * 2 + brute(["a b c", None])[1:] * 2


def test_sketch_estimates_similarity():
    densifier, rng = Densifier(BINS), np.random.default_rng(0)
    for n, share in ((6, 0.5), (60, 0.8), (2000, 0.8)):
        hits = []
        for _ in range(60):
            both = int(n * share)
            values = mix(rng.integers(1 << 62, size=2 * n - both).astype(np.uint64))
            a, b = np.sort(values[:n]), np.sort(values[n - both :])
            hits.append((sketch(a, densifier) == sketch(b, densifier)).mean())
        assert abs(np.mean(hits) - both / (2 * n - both)) < 0.08
    assert len(set(band_keys(sketch(np.array([5], np.uint64), densifier), 25, 5).tolist())) == 25


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 300)] + [(299, 400), (7, 7)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    label = {r.node: r.component for r in found}
    assert len(found) == len(label) == 41 + 200 + 1
    assert {label[k] for k in range(41)} == {0} and {label[k] for k in [*range(100, 300), 400]} == {100}


def test_templated_texts_with_planted_pairs(documents):
    """Forms of one template resemble each other, not enough for a link; some have a near copy."""
    rng = random.Random(4)
    form = [f"t{k}" for k in range(200)]
    slots, texts = range(5, 197, 12), []
    for k in range(500):
        form = list(form)
        for at in slots:
            form[at] = f"own{rng.random()}"
        texts.append(" ".join(form))
        if k % 5 == 0:
            copy = list(form)
            for at in slots[:10]:
                copy[at] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    expected = brute(texts)
    assert sum(not kept for *_, kept in expected) == 100
    assert collect(near_duplicates(documents(texts))) == expected
