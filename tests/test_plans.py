from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qloom.operators import curate, score
from qloom.plans import (
    cut_lineage,
    exact_median,
    first_by_hash,
    hash_cutoffs,
    inline_if_small,
    lookup_join,
    order_statistics,
    ranking,
    ranks_of_values,
    skew,
)


@pytest.fixture
def skewed(spark):
    """A third of all rows share one key; some keys have no lookup row, some are NULL."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k")
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [False, True])
def test_hashed_lookup_equals_plain_join_and_sorts_no_facts(spark, skewed, how, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(skew, "SAMPLE_FRACTION", 1.0)
        monkeypatch.setattr(skew, "MIN_SAMPLED_ROWS", 40)
    monkeypatch.setattr(skew, "SPREAD", 8)
    lookup = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hashed, sorted_ones = (lookup_join(skewed, lookup, ["k"], how, hashed=h) for h in (True, False))
    assert sorted(map(repr, hashed.collect())) == sorted(map(repr, sorted_ones.collect()))
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_leak_corrected_scores_sort_no_scores(spark):
    scored = spark.range(90).selectExpr("id % 30 AS question_id", "concat('a', id % 3) AS arm", "id % 2 AS score")
    leaked = spark.range(0, 30, 5).selectExpr("id AS question_id")
    found = score.leak_corrected_scores(scored, leaked)
    got = {r.arm: (r.n, r.n_clean) for r in found.collect()}
    assert got == {"a0": (30, 24), "a1": (30, 24), "a2": (30, 24)}
    train = spark.createDataFrame([(1, "d", "SELECT a FROM t"), (2, "d", "SELECT b FROM t")], "pair_id int, db_id string, sql string")
    asked = spark.createDataFrame([(7, "d", "select a from t")], "question_id int, db_id string, gold_sql string")
    leaks = curate.find_leaks(train, asked)
    assert [(r.pair_id, r.question_id) for r in leaks.collect()] == [(1, 7)]
    for df in (found, leaks):
        assert "SortMergeJoin [" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [False, True])
def test_lookup_join_equals_plain_join(spark, skewed, how, hot, monkeypatch):
    if hot:
        # Small enough that the sample sees hot keys, with and without a lookup row.
        monkeypatch.setattr(skew, "SAMPLE_FRACTION", 1.0)
        monkeypatch.setattr(skew, "MIN_SAMPLED_ROWS", 40)
    lookup = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(
        spark.createDataFrame([(7, None)], "k bigint, v bigint")
    )
    got = sorted(map(repr, lookup_join(skewed, lookup, ["k"], how).collect()))
    want = sorted(map(repr, skewed.join(lookup, ["k"], how).select(*lookup_join(skewed, lookup, ["k"], how).columns).collect()))
    assert got == want


def test_hot_rows_leave_their_reducer(spark, skewed, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLE_FRACTION", 1.0)
    monkeypatch.setattr(skew, "MIN_SAMPLED_ROWS", 500)
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in off}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        joined = lookup_join(skewed, lookup, ["k"]).withColumn("part", F.spark_partition_id())
        sizes = {r.part: r["count"] for r in joined.filter("k = 7").groupBy("part").count().collect()}
        nulls = joined.filter("k IS NULL").select("part").distinct().count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(sizes) == 8 and max(sizes.values()) < 300 and nulls > 1
    assert sum(sizes.values()) == skewed.filter("k = 7").count()


def test_lookup_keys_of_another_width_still_match(spark, skewed):
    narrow = spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
    assert lookup_join(skewed, narrow, ["k"], "inner").count() == skewed.filter("k IS NOT NULL").count()


def test_order_statistics_match_sorting(spark):
    rng = random.Random(5)
    data = [("hot", rng.choice([1.5, rng.random()])) for _ in range(2500)] + [("cold", float(i)) for i in range(7)] + [("cold", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {
        (r.g, r.label): r.value
        for r in order_statistics(df, ["g"], "v", {"mid": lambda n: F.floor(n / 2) + 1, "max": lambda n: n}).collect()
    }
    for g in ("hot", "cold"):
        values = sorted(v for name, v in data if name == g and v is not None)
        assert got[(g, "mid")] == values[len(values) // 2]
        assert got[(g, "max")] == values[-1]


def test_ranges_grow_with_partitions_and_split_a_hot_group(spark):
    """A group of many values lies in as many ranges as there are partitions; ranks stay right."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 900)).alias("g"),
        F.concat(F.lit("x" * 150), F.lpad((F.col("id") * 7919 % 6007).cast("string"), 5, "0")).alias("v"),
    )
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    try:
        for partitions in (3, 12):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            ranged, places = ranking._ranges(df, ["g"], "v")
            rows = ranged.filter("g = 'hot'").groupBy("__p").count().collect()
            seen.append(len(rows))
            assert max(r["count"] for r in rows) < 2 * 6000 / partitions
            assert places.count() <= 301 + partitions
            got = {r.g: r.value for r in order_statistics(df, ["g"], "v", {"last": lambda n: n}).collect()}
            assert got == {r.g: r.v for r in df.groupBy("g").agg(F.max("v").alias("v")).collect()}
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    assert seen[0] < seen[1] and seen[1] >= 6


def test_ranks_of_no_rows_and_of_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert ranks_of_values(df, "v").count() == 0
    assert order_statistics(df, [], "v", {"first": lambda n: F.lit(1)}).count() == 0


def test_exact_median_averages_the_middle(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (20,)], "v int")
    assert exact_median(df, [], "v").collect()[0].median == 6.0


def test_ranks_of_values_share_a_rank(spark):
    values = [random.Random(1).randrange(900) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r.v: r["rank"] for r in ranks_of_values(df, "v").collect()}
    assert got == {v: 1 + sum(x > v for x in values) for v in set(values)}
    rising = {r.v: r["rank"] for r in ranks_of_values(df, "v", descending=False).collect()}
    assert rising == {v: 1 + sum(x < v for x in values) for v in set(values)}


def test_first_by_hash_takes_the_exact_number(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 % 2).alias("g"))
    flagged = first_by_hash(df, ["g"], "id", lambda n: F.bround(n * 0.15, 0), flag="chosen")
    counts = {r.g: (r.n, r.c) for r in flagged.groupBy("g").agg(F.count("*").alias("n"), F.count_if("chosen").alias("c")).collect()}
    assert counts == {0: (667, 100), 1: (333, 50)}


def test_hash_cutoffs_clamp_and_skip(spark):
    cut = {r.label: r for r in hash_cutoffs(spark.range(10), [], "id", {"all": lambda n: F.lit(99), "none": lambda n: F.lit(0)}).collect()}
    assert cut["all"]["size"] == 10 and "none" not in cut


def test_inline_if_small_refuses_large_frames(spark):
    small, ok = inline_if_small(spark.range(5), 5)
    assert ok and small.count() == 5
    large, ok = inline_if_small(spark.range(6), 5)
    assert not ok and large.count() == 6


def test_cut_lineage_keeps_rows(spark):
    assert cut_lineage(spark.range(4).repartition(2)).count() == 4


def test_no_unbounded_window_or_cross_join_in_rank_plan(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    plan = lookup_join(df, ranks_of_values(df, "v"), ["v"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_key_bits_hold_every_key_and_few_others(spark):
    from qloom.plans import key_bits, may_hold

    keys = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.xxhash64("id")).alias("k"))
    asked = spark.range(100_000).select("id", F.xxhash64("id").alias("k"))
    passed = {r.id for r in asked.filter(may_hold(key_bits(keys), F.col("k"))).collect()}
    held = {i for i in range(5000) if i % 7}
    assert held <= passed and len(passed - held) < 100
    assert asked.filter(may_hold(key_bits(keys.limit(0)), F.col("k"))).count() == 0


def test_overlap_moves_only_hashes_that_an_item_has(spark):
    from qloom.operators import overlap

    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', id * 1000 + i))) AS text")
    items = docs.filter("doc_id < 3").selectExpr("doc_id AS item_id", "concat_ws(' ', slice(split(text, ' '), 50, 20)) AS text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    moved = []
    cut = overlap.cut_lineage

    def watch(df):
        moved.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    overlap.cut_lineage = watch
    try:
        got = {(r.doc_id, r.item_id, r.shared) for r in overlap.ngram_overlap(docs, items).collect()}
    finally:
        overlap.cut_lineage = cut
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(i, i, 17) for i in range(3)}
    # The filter on the table of bits stands between the n-grams and the join, and what is
    # joined are ids, sizes and hashes.
    lines = moved[0].splitlines()
    join = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    below = next(i for i, line in enumerate(lines) if i > join and "scalar-subquery" in line)
    assert "Filter" in lines[below] and any("Generate explode" in line for line in lines[below + 1 :])


def test_overlap_splits_a_hash_that_many_texts_hold(spark, monkeypatch):
    from qloom.operators import overlap

    monkeypatch.setattr(overlap, "HOT_ROWS", 10)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('a b c d e f g h ', id) AS text")
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e z"), (3, "")], "item_id int, text string")
    got = sorted((r.doc_id, r.item_id, r.shared, r.total) for r in overlap.ngram_overlap(docs, items, threshold=0.6).collect())
    assert got == sorted([(i, 1, 5, 5) for i in range(200)] + [(i, 2, 2, 3) for i in range(200)])
