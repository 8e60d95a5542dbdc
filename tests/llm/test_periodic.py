from __future__ import annotations

import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from shared import documents, odd, prose  # noqa: F401

from qloom.llm import periodic, suite
from qloom.llm.common import read_table
from qloom.llm.words import mix

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every lag, every diagonal; of equal stretches the smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - p]:
                i += 1
            if i - first + p >= max(24, 3 * p):
                found.setdefault((first - p, i - first + p), p)
    return sorted((s, l, p) for (s, l), p in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    g, rest = divmod(crc32(str(doc_id).encode()), 10)
    if rest == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, l, p in runs for i in range(s + p, s + l)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def texts_with_runs(rng, many):
    for _ in range(many):
        alphabet, words = rng.choice([1, 2, 3, 5, 50]), []
        while len(words) < rng.choice([0, 5, 30, 100, 300]):
            turn = rng.random()
            if turn < 0.4:
                piece = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 40))]
                words += piece * rng.randrange(1, 7) + piece[: rng.randrange(len(piece))]
            elif turn < 0.7 and words:
                first = rng.randrange(len(words))
                words += words[first : first + rng.randrange(1, 60)] * rng.randrange(1, 4)
            else:
                words += [rng.randrange(alphabet) for _ in range(rng.randrange(1, 30))]
        yield words


def test_runs_equal_brute_force():
    rng, count = random.Random(3), 0
    for _ in range(150):
        texts = list(texts_with_runs(rng, rng.randrange(1, 6)))
        rows = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        words = mix(np.array([w + 77 for t in texts for w in t], np.uint64))
        found = periodic.find_runs(words, rows)
        for k, text in enumerate(texts):
            expected = brute_runs(text)
            assert [tuple(r[1:]) for r in found.tolist() if r[0] == k] == expected
            count += len(expected)
    assert count > 100


def test_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in suite.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    assert got == {d.doc_id: brute_row(d.doc_id, d.text) for d in docs}
    assert sum(row[0] > 0 for row in got.values()) >= 10


def test_odd_texts_and_columns(documents, odd, prose):
    found = periodic.periodic_runs(documents([*odd, prose(1), " ".join(["ab c"] * 20)])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.collapsed_sha256 for r in found[:3]] == [empty] * 3
    assert [r.n_words for r in found[:3]] == [0, 0, 0]
    assert found[8].runs == [(0, 30_000, 1)] and found[8].n_kept == 1
    assert found[12].runs == [] and found[12].collapsed_sha256 == hashlib.sha256(prose(1).encode()).hexdigest()
    assert found[13].runs == [(0, 40, 2)] and found[13].collapsed_sha256 == hashlib.sha256(b"ab c").hexdigest()


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30), (5, None), (5, None)], "doc_id long, text string")
    found = periodic.periodic_runs(docs, rotate=True).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == [None, None, 5, 5] and found[0] == found[1] and found[2] == found[3]
    assert found[0].runs == [(0, 30, 1)]
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def test_very_long_texts_stay_fast():
    for words in (np.zeros(1_000_000), np.arange(1_000_000) % 1000, np.arange(1_000_000)):
        began = time.perf_counter()
        periodic.find_runs(mix(words.astype(np.uint64)), np.array([0, len(words)]))
        assert time.perf_counter() - began < 20


def test_many_partitions_agree(spark):
    docs = read_table(spark, SF, "documents")
    one = periodic.periodic_runs(docs.coalesce(1)).select(F.bit_xor(F.xxhash64("*"))).first()
    assert one == periodic.periodic_runs(docs.repartition(13)).select(F.bit_xor(F.xxhash64("*"))).first()
