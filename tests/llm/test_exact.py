from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import hashlib
import random

from qloom.llm.exact import exact_duplicates


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for number, text in rows:
        groups.setdefault((text or "").translate(lower), []).append(number)
    out = []
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, number in enumerate(sorted(ids)):
            out.append((number, max(ids), len(ids), k == len(ids) - 1, sha))
    return sorted(out)


def collect(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_odd_texts(documents, odd):
    docs = documents(odd)
    assert collect(exact_duplicates(docs)) == brute(enumerate(odd))


def test_empty_table(documents):
    assert exact_duplicates(documents([])).collect() == []


def test_repeated_rows_keep_one(documents):
    docs = documents(["Ab", "aB"])
    assert collect(exact_duplicates(docs.union(docs))) == brute([(0, "Ab"), (1, "aB")] * 2)


def test_null_ids_are_the_smallest(spark):
    rows = [(None, "Ab"), (3, "aB"), (None, "x"), (None, "X"), (None, None), (5, ""), (-4, "only")]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got)
    assert found == sorted(
        [(False, 0, 3, 2, False), (True, 3, 3, 2, True), (False, 0, 0, 2, False), (False, 0, 0, 2, True)]
        + [(False, 0, 5, 2, False), (True, 5, 5, 2, True), (True, -4, -4, 1, True)]
    )
    assert all(r.keep_id is None for r in got if r.doc_id is None and r.keep_id not in (3, 5))


def test_groups_over_many_partitions(spark, documents):
    rng = random.Random(2)
    long = "same beginning " * 20
    texts = [rng.choice(["hot", "HOT", long + "a", long + "b", long + str(k % 97), f"own {k}"]) for k in range(4000)]
    texts += ["hot"] * 3000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collect(exact_duplicates(documents(texts))) == brute(enumerate(texts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
