from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from shared import documents, odd, prose  # noqa: F401

from qloom.llm import ngram_join
from qloom.llm.ngram_join import Rule


def shingle_set(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[k : k + size]) for k in range(len(words) - size + 1))


def brute(rows, percent=90, size=3):
    """doc_id -> (set size, smallest id reachable), from all pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, one) in enumerate(sets):
        for j, other in sets[:k]:
            both = len(one & other)
            if both and 100 * both >= percent * len(one | other):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def changed(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        turn = rng.random()
        if turn < 0.5:
            words[at] = rng.choice(vocabulary)
        elif turn < 0.75:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 5:
            del words[at]
    return words


def families(rng, groups, members, vocabulary, lengths=(20, 120)):
    """Copies of copies, texts from one template, and unrelated ones."""
    out = []
    for _ in range(groups):
        first = [rng.choice(vocabulary) for _ in range(rng.randint(*lengths))]
        kind, line = rng.random(), [first]
        for _ in range(rng.randint(1, members)):
            base = rng.choice(line) if kind < 0.4 else line[-1] if kind < 0.6 else first
            line.append(changed(rng, base, rng.randint(0, 3), vocabulary))
        out += [" ".join(w) for w in line]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, words", [(1, 4000), (2, 60), (3, 12)])
def test_equals_all_pairs(spark, monkeypatch, seed, words):
    """Groups far larger than a crowd, frequent words included."""
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    rng = random.Random(seed)
    rows = families(rng, 12, 50, [f"w{k}" for k in range(words)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.ngram_jaccard_join(docs)) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(500)]
    first = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(k, " ".join(changed(rng, first, rng.randint(1, 4), vocabulary))) for k in range(500)]
    assert result(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_template_texts_make_few_candidates(spark, monkeypatch):
    """Texts that share nine tenths of their words, but no more: keys are crowded, links few."""
    rng = random.Random(4)
    frame = [f"t{k}" for k in range(300)]
    seen = []
    inner = ngram_join.compared

    def counted(pairs, sets, rule):
        seen.append(pairs.count())
        return inner(pairs, sets, rule)

    monkeypatch.setattr(ngram_join, "compared", counted)
    made = []
    for many in (400, 1200):
        rows = [
            (k, " ".join(frame + [f"v{k}x{j}" for j in range(22)]))
            for k in range(many)
        ]
        rows += [(many + k, rows[7 * k][1] + " more words") for k in range(20)]
        seen.clear()
        got = result(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
        assert all(got[many + k][1] == 7 * k for k in range(20))
        assert len({c for _, c in got.values()}) == many
        made.append(sum(seen))
    assert made[1] <= 4 * max(made[0], 20)


def test_other_sizes_and_shares(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    rows = families(random.Random(6), 8, 30, [f"w{k}" for k in range(40)], (3, 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((1, 60), (2, 80), (4, 100)):
        assert result(ngram_join.ngram_jaccard_join(docs, size, percent)) == brute(rows, percent, size)


def test_prefix_keeps_every_link():
    """Two linked sets share at least the smaller number of matches in their prefixes."""
    rng, rule = np.random.default_rng(1), Rule(90)
    counts_of = {int(h): int(c) for h, c in zip(range(3000), rng.integers(1, 2000, 3000), strict=True)}
    for _ in range(400):
        n = int(rng.integers(1, 120))
        one = np.sort(rng.choice(3000, n, replace=False)).astype(np.uint64)
        other = set(one.tolist())
        for _ in range(int(rng.integers(0, max(1, n // 9) + 1))):
            other.discard(int(rng.choice(one)))
            if rng.random() < 0.5:
                other.add(int(rng.integers(0, 3000)))
        other = np.array(sorted(other), np.uint64)
        both = len(np.intersect1d(one, other))
        if not len(other) or not rule.links(both, len(one), len(other)):
            continue
        found = [
            ngram_join.choose_prefix(s, np.array([counts_of[int(h)] for h in s]), int(rng.integers(0, 900)), rule)
            for s in (one, other)
        ]
        assert len(np.intersect1d(found[0][1], found[1][1])) >= min(found[0][0], found[1][0])


def test_odd_texts_and_columns(documents, odd, prose):
    texts = [*odd, prose(1), prose(1).upper(), prose(1).replace(" ", "\n\t")]
    got = result(ngram_join.ngram_jaccard_join(documents(texts)))
    assert got == brute(list(enumerate(texts)))
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[6] == (1, 5)


def test_repeated_null_and_no_rows(spark, prose):
    rows = [(3, prose(1)), (3, prose(1)), (None, prose(1)), (None, prose(2)), (1, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert len(got) == 6
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.component_id) == [
        (False, 1, 1), (False, 1, 1), (False, 3, 3), (False, 3, 3), (True, 0, 3)
    ]
    assert ngram_join.ngram_jaccard_join(docs.filter("false")).count() == 0


def test_unrelated_texts_are_not_written_whole(spark, monkeypatch):
    """Where estimates tell nothing, as in large inputs, frequent shingles stand in many prefixes; the sets that
    hold them must not be written, nor their differences. Three near copies are found all the same."""
    monkeypatch.setattr(ngram_join, "estimated_counts", lambda docs, size: np.ones(ngram_join.COUNTERS, np.int64))
    monkeypatch.setattr(ngram_join, "CROWD", 8)
    written, inner = [], ngram_join.stored

    def measured(df):
        out = inner(df)
        written.extend(Path(f.removeprefix("file:")).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "stored", measured)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    texts = [rng.choices(vocabulary, weights, k=1200) for _ in range(250)]
    texts += [changed(rng, texts[k], 9, vocabulary) for k in (3, 50, 77)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = result(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert [got[k][1] for k in (250, 251, 252)] == [3, 50, 77]
    assert sum(written) < 8 * sum(n for n, _ in got.values())


def test_pairs_within_a_component_are_not_read(spark, monkeypatch):
    """Groups of near copies, smaller than a crowd: a set is compared about once, not with its whole group."""
    compares, inner = [], ngram_join.compared

    def counted(pairs, sets, rule):
        compares.append(pairs.count())
        return inner(pairs, sets, rule)

    monkeypatch.setattr(ngram_join, "compared", counted)
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows = []
    for _ in range(12):
        first = [rng.choice(vocabulary) for _ in range(300)]
        rows += [" ".join(changed(rng, first, 2, vocabulary)) for _ in range(24)]
    rows = list(enumerate(rows))
    got = result(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert sum(compares) <= 2 * len(rows)


def test_parity_is_never_more_than_the_difference():
    rng, rule = np.random.default_rng(3), Rule(90)
    for n, m in ((1, 1), (60, 70), (500, 530), (1000, 1100), (5, 4000)):
        one, other = (np.unique(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in (n, m))
        other = np.unique(np.concatenate((one[: n - n // 30], other[: max(0, m - n)], other[: n // 30])))
        apart = ngram_join.parity_apart(ngram_join.parity_bits(one), ngram_join.parity_bits(other))
        assert apart == ngram_join.parity_apart(ngram_join.parity_bits(other), ngram_join.parity_bits(one))
        assert apart <= len(np.setxor1d(one, other))
        if rule.links(len(np.intersect1d(one, other)), len(one), len(other)):
            assert rule.may_link(apart, len(one), len(other))
    one, other = (np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64)) for _ in "ab")
    assert not rule.may_link(ngram_join.parity_apart(*map(ngram_join.parity_bits, (one, other))), len(one), len(other))


def test_unpacked_texts_give_their_sets(monkeypatch, prose):
    monkeypatch.setattr(ngram_join, "UNPACKED", 300)
    texts = [prose(k, words) for k, words in enumerate((5, 900, 40, 1, 60, 2))]
    packed = pa.array([pa.compress(t.encode(), codec="zstd", asbytes=True) for t in texts], pa.binary())
    lengths = pa.array([len(t.encode()) for t in texts], pa.int64())
    hasher = ngram_join.Hasher()
    found = list(ngram_join.unpacked(lengths, packed, 3, hasher))
    direct = list(ngram_join.distinct_shingles(pa.array(texts), 3, hasher))
    assert all(np.array_equal(a, b) for a, b in zip(found, direct, strict=True))
    assert list(ngram_join.unpacked(lengths[:0], packed[:0], 3, hasher)) == []


@pytest.mark.parametrize("crowd", [4, 32])
def test_stars_first_equals_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "STARS", 0)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rows = families(random.Random(5 + crowd), 10, 30, [f"w{k}" for k in range(200)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.ngram_jaccard_join(docs)) == brute(rows)
