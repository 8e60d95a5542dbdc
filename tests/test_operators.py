from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from qloom.operators import containment, curate, generate, outcomes, overlap, profile, schema_text, score, tasks, usage, workload
from qloom.sources import records, tables

# --- result sets ---------------------------------------------------------------


def equal(gold, pred, **kw):
    return outcomes.result_sets_equal(gold, pred, **kw).first().equal


def test_sets_ignore_order_copies_and_names(rows):
    gold, pred = rows([(1, "a"), (2, "b")], "x int, y string"), rows([(2, "b"), (1, "a"), (1, "a")], "p int, q string")
    assert equal(gold, pred) and equal(pred, gold)


def test_column_order_matters(rows):
    assert not equal(rows([(1, 2)], "a int, b int"), rows([(2, 1)], "a int, b int"))


def test_null_rows_are_equal(rows):
    assert equal(rows([(None, 1)], "a string, b int"), rows([(None, 1)], "a string, b int"))


def test_numbers_of_any_type_are_equal_but_text_is_not(rows):
    one = rows([(1,)], "a int")
    assert equal(one, rows([(1.0,)], "a double"))
    assert equal(one, rows([(Decimal("1.00"),)], "a decimal(10,2)"))
    assert equal(one, rows([(True,)], "a boolean"))
    assert not equal(one, rows([("1",)], "a string"))


def test_strict_tells_decimal_from_binary_fraction(rows):
    tenth, exact = rows([(0.1,)], "a double"), rows([(Decimal("0.25"),)], "a decimal(10,2)")
    assert equal(tenth, rows([(Decimal("0.1"),)], "a decimal(10,1)"))
    assert equal(exact, rows([(0.25,)], "a double"), strict=True)


def test_width_and_emptiness(rows):
    none, wide = rows([], "a int"), rows([], "a int, b int")
    assert equal(none, rows([], "a string")) and equal(none, wide)
    assert not equal(rows([(1,)], "a int"), rows([(1, 2)], "a int, b int"))
    assert not equal(rows([(1,)], "a int"), none)


def test_large_integers_stay_exact(rows):
    assert not equal(rows([(2**53,)], "a bigint"), rows([(2**53 + 1,)], "a bigint"))


def test_batch_compare_counts_silent_questions_as_equal(rows):
    results = rows([(1, "gold", "a"), (1, "pred", "a"), (2, "gold", "a")], "query_id int, side string, c string")
    got = outcomes.batch_result_compare(results, ["c"], questions=rows([(1,), (2,), (3,)], "query_id int"))
    assert {r.query_id: r.equal for r in got.collect()} == {1: True, 2: False, 3: True}


def test_run_candidates_reports_each_end(spark):
    spark.range(3).createOrReplaceTempView("tiny")
    got = {
        r.statement_id: r
        for r in outcomes.run_candidates(
            spark,
            [
                ("ok", "SELECT id FROM tiny"),
                ("none", "SELECT id FROM tiny WHERE id > 9"),
                ("bad", "SELECT nope FROM tiny"),
                ("write", "DROP TABLE tiny; SELECT 1 FROM tiny"),
            ],
            empty_is_error=True,
        ).collect()
    }
    assert (got["ok"].status, got["ok"].row_count, got["ok"].columns) == ("success", 3, "id")
    assert (got["none"].status, got["none"].error) == ("error", "empty result")
    assert got["bad"].status == "error" and len(got["bad"].error) <= 150 and "nope" in got["bad"].error
    assert "read-only" in got["write"].error


def test_statements_over_the_time_limit_are_cancelled(spark):
    slow = [("slow", "SELECT count(*) FROM range(100000000000) a WHERE hash(a.id) = 1")]
    assert outcomes.run_candidates(spark, slow, timeout_seconds=3).first().error == "timeout"
    assert not spark.sparkContext.statusTracker().getActiveStageIds()


def test_ambiguity_decides_before_execution(rows):
    df = rows(
        [("ambiguous", "ambiguous", None), ("ambiguous", "SELECT 1", True), ("SELECT 1", "ambiguous", True),
         ("SELECT 1", "error", True), ("SELECT 1", "SELECT 1", True), ("SELECT 1", "SELECT 1", None)],
        "gold_sql string, predicted_sql string, correct boolean",
    )
    assert [r.score for r in outcomes.score_questions(df).collect()] == [1, 0, 0, 0, 1, 0]


# --- scores ----------------------------------------------------------------------


def scored(rows, data):
    return rows(data, "arm string, seed int, difficulty string, score bigint, t_gold double, t_pred double")


def test_untimed_predictions_count_as_slow(rows):
    df = scored(rows, [("a", 0, "simple", 1, 4.0, 1.0), ("a", 0, "simple", 1, 1.0, 0.0), ("a", 0, "simple", 0, 1.0, 1.0)])
    overall = score.efficiency_score(df).filter("level = 'overall'").first()
    assert overall.ves == pytest.approx(200 / 3, abs=1e-5) and overall.n == 3


def test_leaderboard_skips_arms_with_a_missing_seed(rows):
    df = scored(rows, [("a", 0, "s", 1, 1.0, 1.0), ("a", 1, "s", 0, 1.0, 1.0), ("b", 0, "s", 1, 1.0, 1.0)])
    board = score.leaderboard(df, expected_seeds=2).collect()
    assert [(r.arm, r.ex_mean, r.ex_sigma, r.ex_all) for r in board] == [("a", 50.0, 50.0, "100.00 / 0.00")]


def test_no_rows_score_zero(rows):
    assert score.execution_accuracy(scored(rows, [])).filter("level = 'overall'").first().ex == 0.0


def test_single_seed_prints_the_plain_mean(spark):
    df = spark.range(1).select(score.plus_minus(F.lit(41.027), F.lit(1.366), F.lit(1)), score.plus_minus(F.lit(41.027), F.lit(1.366), F.lit(3)))
    assert tuple(df.first()) == ("41.03", "41.03 ± 1.37")


def test_usage_total_falls_back(rows):
    calls = rows([("a", 3, 4, 0), ("a", 3, 4, None), ("a", 3, 4, 9)], "arm string, prompt_tokens int, completion_tokens int, total_tokens int")
    assert usage.usage_totals(calls, ["arm"]).first().total_tokens == 7 + 7 + 9


# --- curation --------------------------------------------------------------------

PAIR = "pair_id int, db_id string, question string, sql string, difficulty string, parse_ok boolean, exec_ok boolean, row_count bigint"


def test_repeats_before_the_first_kept_pair_keep_their_own_reason(rows):
    pairs = rows(
        [(1, "d", "q", "SELECT a FROM t WHERE 1=1", None, True, False, 0), (2, "d", "q", "select a from t where 1=1;", None, True, True, 0),
         (3, "d", "q", "SELECT a  FROM t WHERE 1=1", None, True, True, 2), (4, "d", "q", "SELECT a FROM t WHERE 1=1", None, True, False, 0),
         (5, "d", "q", "SELECT a FROM", None, False, False, 0), (6, "d", "q", "SELECT * FROM t", None, True, True, 9)],
        PAIR,
    )
    judged = curate.filter_pairs(pairs)
    assert {r.pair_id: r.reason for r in judged.collect()} == {
        1: "fails to run", 2: "empty", 3: "kept", 4: "duplicate", 5: "unparsable", 6: "trivial",
    }
    report = curate.reject_report(judged).collect()
    assert sum(r.n for r in report) == 6 and sum(r.share for r in report) == pytest.approx(100, abs=0.01)


def test_leaks_need_the_same_database_and_the_later_question_owns(rows):
    train = rows([(1, "d", "q", "SELECT DISTINCT T.a FROM t AS T"), (2, "e", "q", "SELECT a FROM t"), (3, "d", "q", "SELECT b FROM t")],
                 "pair_id int, db_id string, question string, sql string")
    asked = rows([(10, "d", "select a from t"), (11, "d", "SELECT a FROM t;")], "question_id int, db_id string, gold_sql string")
    assert [(r.pair_id, r.question_id) for r in curate.find_leaks(train, asked).collect()] == [(1, 11)]
    assert sorted(r.pair_id for r in curate.drop_leaks(train, asked).collect()) == [2, 3]
    assert curate.leak_totals(train, asked).first().passed is False
    assert curate.leak_totals(train.filter("pair_id > 1"), asked).first().passed is True


def test_leaks_are_marked_in_one_reading(spark, rows):
    train = rows([(1, "d", "select a from t"), (2, "d", "select b from t"), (3, "e", "select a from t"), (4, None, None)], "pair_id int, db_id string, sql string")
    asked = rows([(11, "d", "SELECT a FROM t;"), (None, "d", "select b from t")], "question_id int, db_id string, gold_sql string")
    assert {r.pair_id: r.leaks for r in curate.mark_leaks(train, asked).collect()} == {1: True, 2: True, 3: False, 4: False}
    part = rows([("d", "x", "t")], "db_id string, difficulty string, task string")
    # Sections read the kept counts, not the rows again.
    plan = curate.manifest(part, part, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [part" not in plan


def test_split_keeps_every_row_and_one_validation_row(spark):
    pairs = spark.range(103).select(F.col("id").alias("pair_id"), F.when(F.col("id") < 3, "small").otherwise("big").alias("db_id"))
    counts = {(r.db_id, r.split): r["count"] for r in curate.stratified_split(pairs).groupBy("db_id", "split").count().collect()}
    assert counts == {("small", "val"): 1, ("small", "train"): 2, ("big", "val"): 15, ("big", "train"): 85}


def test_small_variants_are_subsets(spark):
    got = curate.nested_sizes(spark.range(40).withColumnRenamed("id", "pair_id"), [5, 12, 99]).collect()
    sets = {v: {r.pair_id for r in got if r.variant == v} for v in (5, 12, 99)}
    assert sets[5] < sets[12] < sets[99] and [len(sets[v]) for v in (5, 12, 99)] == [5, 12, 40]


def brute_overlap(docs, items, n, threshold):
    def grams(value):
        words = value.lower().split()
        return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}

    out = set()
    for i, item in items:
        want = grams(item)
        for d, doc in docs:
            shared = len(want & grams(doc))
            if want and shared and shared >= threshold * len(want) - 1e-9:
                out.add((d, i, shared, len(want)))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_overlap_equals_brute_force(spark, threshold):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    docs += [(100 + i, "x " + items[i % 12][1] + " y") for i in range(30)]  # copies of evaluation texts
    got = overlap.ngram_overlap(
        spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), n=2, threshold=threshold
    )
    assert {(r.doc_id, r.item_id, r.shared, r.total) for r in got.collect()} == brute_overlap(docs, items, 2, threshold)


def test_containment_equals_brute_force(spark):
    texts = [(0, "banana split"), (1, "an"), (2, ""), (3, "naïve ban"), (4, "split")]
    patterns = ["an", "n", "ban", "split", "banana s", "zzz", "ï", "na split"]
    got = containment.containment_join(
        spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(p,) for p in patterns], "p string"), "id", "t", "p"
    )
    assert {(r.id, r.p) for r in got.collect()} == {(i, p) for i, t in texts for p in patterns if p in t}


# --- tasks and generation ----------------------------------------------------------


def test_cut_at_middle_clause(rows):
    df = rows([("SELECT a FROM t WHERE b GROUP  BY c ORDER BY d",), ("SELECT a FROM t",), ("SELECT a FROM t LIMIT 1",)], "sql string")
    got = [[tuple(c) for c in (r[0] or [])] for r in df.select(tasks.cut_at_middle_clause(F.col("sql"))).collect()]
    assert got == [[("SELECT a FROM t WHERE b", "GROUP  BY c ORDER BY d")], [], [("SELECT a FROM t", "LIMIT 1")]]


def test_noise_swaps_one_occurrence(spark, rows):
    pairs = rows([(1, "d", "q", "SELECT a, a FROM t"), (2, "d", "q", "SELECT 1 FROM t")], "pair_id int, db_id string, question string, sql string")
    schema = rows([("d", ["t"], ["a", "b"], ["t.a", "t.b"])], "db_id string, known_tables array<string>, known_columns array<string>, known_names array<string>")
    got = tasks.noise_correction_task(pairs, schema).collect()
    assert [(r.pair_id, r.user, r.target) for r in got] == [(1, "question: q\nSQL: SELECT b, a FROM t", "SELECT a, a FROM t")]


def test_fill_leaves_other_braces(spark):
    df = spark.range(1).select(tasks.fill("{x} {y} {x}{{z}}", {"x": F.lit("1"), "z": F.lit(None)}))
    assert df.first()[0] == "1 {y} 1{}"


def test_generation_reports_failures(rows):
    def model(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return {"blank": "  ", "none": None}.get(prompt, f" {prompt}! ")

    df = rows([("a",), ("boom",), ("blank",), ("none",)], "prompt string")
    got = {r.prompt: (r.reply, r.failure) for r in generate.batch_generate(df, model).collect()}
    assert got == {"a": ("a!", None), "boom": (None, "RuntimeError: down"), "blank": (None, "empty reply"), "none": (None, "empty reply")}


def test_retry_gives_up_after_the_limit(rows):
    def model(prompt):
        number, attempt = prompt.split("#")
        return "SELECT a FROM t" if int(attempt) >= int(number) else "DROP TABLE t"

    got = generate.retry_until_valid(
        rows([("1",), ("3",), ("9",)], "prompt string"), model, max_attempts=3,
        ask_again=lambda value, attempt: F.concat(value, F.lit(f"#{attempt}")),
    ).collect()
    assert {r.prompt: (r.attempts, r.status) for r in got} == {"1": (1, "success"), "3": (3, "success"), "9": (3, "error")}


def test_quick_calls_cost_no_future_each():
    class Counted(ThreadPoolExecutor):
        submitted = 0

        def submit(self, *args, **kwargs):
            Counted.submitted += 1
            return super().submit(*args, **kwargs)

    with Counted(3) as pool:
        got = generate.answers_of(pool, lambda value: (value, None), [str(k) for k in range(1000)], 3)
    assert got == [(str(k), None) for k in range(1000)] and Counted.submitted == 3


# --- profiles and plans ------------------------------------------------------------


def test_profile_of_gaps_and_empty_tables(spark, rows):
    df = rows([(i, None, "v" if i else None) for i in range(3)], "k int, gone string, part string")
    assert {r.column: r.null_frac for r in profile.null_fraction("t", df).collect()} == {"gone": 1.0, "part": 0.333}
    counts = {r.column: (r.distinct_values, r.n_distinct) for r in profile.n_distinct("t", df).collect()}
    assert counts == {"k": (3, -1.0), "gone": (0, 0.0), "part": (1, pytest.approx(-0.333333))}
    none = df.filter("k > 9")
    assert profile.row_counts({"t": none}).first().rows == 0
    assert profile.value_domain("t", none).count() == 0
    assert profile.histogram_bounds("t", none, "k").count() == 0


def test_tiny_null_share_still_shows_as_zero(spark):
    df = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("v"))
    assert profile.null_fraction("t", df).first().null_frac == 0.0


def test_value_domain_lists_or_samples(spark):
    df = spark.range(60).select((F.col("id") % 15).cast("int").alias("few"), F.col("id").cast("int").alias("many"), F.array("id").alias("nested"))
    got = {r.column: (r.kind, len(r["values"])) for r in profile.value_domain_or_error("t", df, ["few", "many", "nested", "absent"]).collect()}
    assert got == {"few": ("all_values", 15), "many": ("sample_values", 5), "nested": ("error", 1), "absent": ("error", 1)}


def test_long_texts_are_told_apart_by_their_ends(rows):
    stem = "x" * 300
    df = rows([(stem + "a",), (stem + "b",), (stem + "b",), ("short",)], "t string")
    assert profile.n_distinct("t", df).first().distinct_values == 3
    top = profile.most_common_values("t", df, 1).first()
    assert (top.value, top.n) == ("x" * 120 + "...", 2)
    assert profile.value_domain("t", df).first()["values"] == ["short", "x" * 120 + "...", "x" * 120 + "..."]


def test_sketch_profile_is_close(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"))
    got = {r.column: r for r in profile.profile_columns("t", df).collect()}
    assert abs(got["id"].distinct_values - 20000) < 2000 and got["s"].distinct_values == 7
    assert got["id"].n_distinct < 0 and sorted(got["s"].most_common) == [str(i) for i in range(7)]


def test_implied_edges_follow_the_later_owner(rows):
    columns = rows([("a", 1, "id"), ("b", 1, "id"), ("c", 1, "id"), ("c", 2, "k"), ("d", 1, "k"), ("d", 2, "m")], "table string, ordinal int, column string")
    keys = rows([("a", 0, ["id"]), ("b", 1, ["id"]), ("d", 3, ["k", "m"])], "table string, order int, key array<string>")
    declared = rows([("c", ["id"])], "table string, columns array<string>")
    assert [(r.table, r.column, r.to_table) for r in profile.implied_edges(columns, keys, declared).collect()] == [("a", "id", "b")]


def test_composite_key_is_rendered(rows):
    columns = rows(
        [("t", 0, 1, "a", "TEXT", False, True, None, ["x", "y", "z", "w"], True), ("t", 0, 2, "b", "BIGINT", True, True, "note", None, False)],
        "table string, table_order int, ordinal int, column string, type string, nullable boolean, is_key boolean, comment string, "
        "examples array<string>, is_text boolean",
    )
    edges = rows([], "position int, table string, column string, to_table string, to_column string")
    assert schema_text.render_mschema(columns, edges, "db").first().text == (
        "【DB_ID】 db\n【Schema】\n# Table: t\n[\n(a:TEXT, Primary Key, NOT NULL. Examples: ['x', 'y', 'z']),\n(b:BIGINT, Primary Key, note),\n]\n"
    )


def plan(kind, *children, relation=None):
    node = {"Node Type": kind}
    if relation:
        node["Relation Name"] = relation
    if children:
        node["Plans"] = list(children)
    return node


def test_plan_walk(rows):
    def scan(name):
        return plan("Seq Scan", relation=name)

    tree = plan("Sort", plan("Hash Join", plan("Nested Loop", scan("b"), scan("a")), plan("Hash", scan("c")), scan("ignored")))
    lonely = plan("Hash Join", scan("x"))
    same = plan("Merge Join", scan("s"), scan("s"))
    df = rows([(i, json.dumps(p)) for i, p in enumerate([tree, lonely, same])], "query_id int, plan_json string")
    nodes = workload.flatten_plans(df)
    assert nodes.filter("query_id = 0").count() == 8 and nodes.agg(F.max("depth")).first()[0] == 3
    assert {r.path: r.nodes for r in workload.join_paths(df).collect()} == {"a|b": 1, "b|c": 1, "a|c": 1}
    assert {r.node_type: r.nodes for r in workload.join_operators(nodes).collect()} == {"Hash Join": 1, "Nested Loop": 1, "Merge Join": 1}
    assert {r.relation: r.nodes for r in workload.table_frequency(nodes).collect()}["s"] == 2


# --- files ---------------------------------------------------------------------------


def test_prediction_files_in_both_shapes(spark, tmp_path):
    (tmp_path / "query_results_lora_seed2.json").write_text(json.dumps({"7": "SELECT 1", "8": {"query": "SELECT 2"}, "9": {"sql": "SELECT 'ж'"}, "10": {}}))
    (tmp_path / "query_results_base.json").write_text('{\n "7": "a\\nb"\n}')
    got = {(r.arm, r.seed, r.question_id): r.sql for r in records.load_predictions(spark, str(tmp_path)).collect()}
    assert got == {
        ("lora", 2, "7"): "SELECT 1", ("lora", 2, "8"): "SELECT 2", ("lora", 2, "9"): "SELECT 'ж'", ("lora", 2, "10"): "",
        ("base", 0, "7"): "a\nb",
    }


def test_records_round_trip(spark, rows, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"db_id": "d", "question": "é?", "sql": "s"}, {"db_id": "d", "question": "q", "sql": "s", "difficulty": "simple"}]))
    loaded = records.load_records(spark, str(tmp_path / "in.json"), records.PAIR_SCHEMA)
    assert sorted(r.difficulty for r in loaded.collect()) == ["simple", "unknown"]
    records.write_records(rows([("d", Decimal("1.5"), "é")], "db_id string, n decimal(5,2), t string"), str(tmp_path / "out"))
    written = "".join(p.read_text() for p in (tmp_path / "out").rglob("*.json"))
    assert json.loads(written) == {"n": 1.5, "t": "é"} and "é" in written


def test_fingerprints_of_absent_files_are_null(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in records.fingerprint_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert got == {"a": "2d711642b726b044", "b": None}


def test_table_version_sees_copies_and_ignores_order(spark):
    base = spark.range(10)
    version = records.table_version(base).first().version
    assert version == records.table_version(base.orderBy(F.desc("id"))).first().version
    assert version != records.table_version(base.union(base)).first().version


def test_first_batch_wins(rows):
    old, new = rows([(5, "q", "s")], "pair_id int, question string, sql string"), rows([(1, "q", "s"), (2, "q", "t")], "pair_id int, question string, sql string")
    assert sorted((r.pair_id, r.sql) for r in records.merge_batches(old, new).collect()) == [(2, "t"), (5, "s")]


def test_tables_of_an_empty_folder_raise(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_tables(spark, str(tmp_path))


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:postgresql://host/db?ssl=true", "t", tables.FILTER_STATEMENT_TIMEOUT)
    assert options["url"].endswith("ssl=true&connectTimeout=15") and options["queryTimeout"] == "15"
    assert options["sessionInitStatement"] == "SET statement_timeout = 15000"


def test_composite_keys_are_minimal(spark):
    """Order lines: neither column alone is a key, both are; no superset is told; NULLs keep a column out."""
    lines = spark.range(4000).selectExpr("id div 4 AS order_id", "id % 4 AS line", "id div 2 % 7 AS qty", "concat('x', id div 4 % 3) AS flag")
    cube = spark.range(1000).selectExpr("id div 100 AS a", "id div 10 % 10 AS b", "id % 10 AS c", "if(id = 5, NULL, id) AS d", "1 AS e")
    single = spark.range(50).selectExpr("id AS k", "id % 5 AS g", "named_struct('x', 1) AS nested")
    tables = {"lines": lines, "cube": cube, "single": single, "none": lines.filter("false")}
    got = {tuple(r) for r in profile.discover_composite_keys(tables, 3).collect()}
    assert got == {("lines", "order_id, line"), ("cube", "a, b, c"), ("single", "k")}
    assert {tuple(r) for r in profile.discover_composite_keys(tables).collect()} == got - {("cube", "a, b, c")}


def test_one_rare_repeat_refutes_a_key(spark):
    rows = spark.range(20_000).selectExpr("id div 2 AS a", "id % 2 AS b").unionByName(spark.createDataFrame([(77, 1)], "a long, b long"))
    assert profile.discover_composite_keys({"t": rows}).count() == 0


def test_edges_of_several_columns(spark):
    parent = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    child = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (None, 1)], "x int, y int")
    found = profile.discover_edges({"p": parent, "c": child}, [(("c", ("x", "y")), ("p", ("a", "b"))), (("c", "x"), ("p", "a"))])
    assert sorted((r["column"], r.to_column, r.missing) for r in found.collect()) == [("x", "a", 0), ("x, y", "a, b", 1)]


def test_first_values_without_shuffling_all(spark, monkeypatch):
    """A bound from a share of the rows leaves nearly all of many values where they are read."""
    monkeypatch.setattr(profile, "SHARE", 0.05)
    df = spark.range(60_000).selectExpr("id * 7919 % 60013 AS many", "id % 4 AS few", "concat(repeat('long ', 40), id) AS text", "if(id % 2 = 0, NULL, 'x') AS one")
    passed, inner = [], profile._cells

    def counted(frame, columns, caps=None):
        cells = inner(frame, columns, caps)
        if caps is not None:
            passed.append({r.column: r["count"] for r in cells.distinct().groupBy("column").count().collect()})
        return cells

    monkeypatch.setattr(profile, "_cells", counted)
    got = {}
    for r in profile.smallest_values("t", df, None, 16).orderBy("rn").collect():
        got.setdefault(r.column, []).append(r.value)
    assert got["many"] == sorted(map(str, {k * 7919 % 60013 for k in range(60_000)}))[:16]
    assert got["few"] == ["0", "1", "2", "3"] and got["one"] == ["x"] and len(got["text"]) == 16
    assert passed[0]["many"] < 2000 and passed[0]["text"] < 2000


@pytest.mark.parametrize("in_flight, concurrency", [(3, 1), (4, 2), (2, 8)])
def test_calls_in_flight_are_bounded_over_all_tasks(spark, tmp_path, in_flight, concurrency):
    """Every call leaves a file while it lasts; with 32 partitions no call ever sees more than the bound."""
    folder = str(tmp_path)

    def model(prompt):
        import os
        import time
        import uuid

        mine = f"{folder}/{uuid.uuid4().hex}"
        open(mine, "w").close()
        time.sleep(0.02)
        seen = len(os.listdir(folder))
        os.remove(mine)
        return str(seen)

    prompts = spark.range(0, 96, 1, 32).select(F.concat(F.lit("p"), "id").alias("prompt"))
    seen = [int(r.reply) for r in generate.batch_generate(prompts, model, concurrency=concurrency, in_flight=in_flight).collect()]
    assert len(seen) == 96 and 1 <= max(seen) <= in_flight
