"""Statements, results and files of shapes the derived tables do not have."""

from __future__ import annotations

import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from qloom.functions import text
from qloom.operators import curate, outcomes, score, tasks, workload
from qloom.sources import records
from qloom.suite import fixtures

# (statement, tables, join keys), the expected columns written by hand.
PARSED = [
    (
        "SELECT EXTRACT(YEAR FROM T1.date) FROM trans AS T1 JOIN account T2 ON T1.account_id = T2.account_id",
        ["account", "trans"],
        ["account.account_id = trans.account_id"],
    ),
    ("SELECT TRIM(BOTH 'x' FROM t.name) FROM people t WHERE t.a IS DISTINCT FROM t.b", ["people"], []),
    (
        "SELECT count(*) FROM main.orders o JOIN main.customer c ON o.cust = c.id WHERE c.x IS NOT DISTINCT FROM o.y",
        ["customer", "orders"],
        ["customer.id = orders.cust"],
    ),
    ("SELECT `a`.`k` FROM `first` a JOIN `second` AS `b` ON `a`.`k` = `b`.`k`", ["first", "second"], ["first.k = second.k"]),
    ('SELECT "k" FROM "first" WHERE name = \'from nowhere\' -- from comment', ["first"], []),
    ("WITH r AS (SELECT id FROM base) SELECT r.id FROM r JOIN other ON r.id = other.id", ["base", "other", "r"], ["other.id = r.id"]),
    ("SELECT substring(s.name FROM 2 FOR 3) FROM (SELECT name FROM inner_table) s", ["inner_table"], []),
]


def test_names_of_real_statements(rows):
    frame = rows([(k, s) for k, (s, *_) in enumerate(PARSED)], "id int, sql string")
    got = frame.select("id", text.accessed_tables(F.col("sql")).alias("t"), text.join_keys(F.col("sql")).alias("k")).collect()
    for r in got:
        assert (list(r.t), list(r.k)) == PARSED[r.id][1:], PARSED[r.id][0]


def test_names_by_scope(rows):
    """Hand-written names of every shape of the registered view, and of broken or empty statements."""
    frame = rows([(k, s.replace("#", "7")) for k, (s, *_) in enumerate(fixtures.STATEMENTS)], "id int, sql string")
    names = frame.select("id", text.statement_names(F.col("sql")).alias("n")).select("id", "n.*")
    for r in names.collect():
        got = tuple(", ".join(x) for x in (r.tables, sorted(r.columns), r.keys))
        assert got == fixtures.STATEMENTS[r.id][1:], fixtures.STATEMENTS[r.id][0]


def test_names_of_odd_statements(rows):
    odd = {
        "": [],
        ")))(((": [],
        "SELECT": [],
        "SELECT a FROM": [],
        "SELECT 1 FROM t1, t2 b, (t3 JOIN t4 ON t3.a = t4.a), t5": ["t1", "t2", "t3", "t4", "t5"],
        "SELECT a FROM s.t1 WHERE x IN (SELECT y FROM t2 WHERE z = (SELECT max(w) FROM t3))": ["t1", "t2", "t3"],
        "SELECT a FROM t1 LEFT OUTER JOIN t2 USING (a) CROSS JOIN t3 NATURAL JOIN t4 ORDER BY a": ["t1", "t2", "t3", "t4"],
        "SELECT v FROM (VALUES (1), (2)) AS t(v) JOIN base ON base.id = t.v": ["base"],
        "SELECT a FROM t1 UNION SELECT b FROM t2 EXCEPT SELECT c FROM t3": ["t1", "t2", "t3"],
        "SELECT " + ", ".join(f"t1.c{k}" for k in range(3000)) + " FROM t1": ["t1"],
        "(" * 300 + "SELECT a FROM t1" + ")" * 300: ["t1"],
    }
    frame = rows([*odd.items(), (None, None)], "sql string, expected array<string>")
    got = frame.select("sql", "expected", text.accessed_tables(F.col("sql")).alias("tables")).collect()
    assert all(r.tables == r.expected for r in got), [(r.sql, r.tables) for r in got if r.tables != r.expected]


def test_names_once_per_shape(rows):
    frame = rows([(k, f"SELECT o.a FROM orders o WHERE o.k = {k % 3} AND o.s = 'x{k}'") for k in range(50)] + [(50, None)], "id int, sql string")
    assert frame.select(text.statement_shape(F.col("sql")).alias("s")).distinct().count() == 2
    found = {r.id: r.names for r in workload.with_names(frame).collect()}
    assert len(found) == 51 and found[50] is None
    assert all(found[k].tables == ["orders"] and found[k].columns == ["orders.a", "orders.k", "orders.s"] for k in range(50))


def test_only_queries_are_read_only(rows):
    statements = {
        "SELECT `update` FROM t": True,
        "-- note\n(SELECT 1 FROM t)": True,
        "with a as (select 1 from t) select * from a": True,
        "REPLACE TABLE t AS SELECT 1 FROM t": False,
        "CACHE TABLE z AS SELECT 1 FROM t": False,
        "TRUNCATE TABLE t": False,
        "/* SELECT */ MERGE INTO t USING u ON true WHEN MATCHED THEN SELECT": False,
    }
    frame = rows(list(statements.items()), "sql string, expected boolean")
    assert all(r.got == r.expected for r in frame.select("expected", text.is_read_only(F.col("sql")).alias("got")).collect())


def test_failures_of_the_select_list_count(spark):
    spark.range(3).selectExpr("id", "'x' AS name").createOrReplaceTempView("tiny_rows")
    got = {
        r.statement_id: r.status
        for r in outcomes.run_candidates(
            spark,
            [
                ("cast", "SELECT CAST(name AS INT) FROM tiny_rows"),
                ("zero", "SELECT id / 0 FROM tiny_rows"),
                ("many", "SELECT (SELECT id FROM tiny_rows) FROM tiny_rows"),
                ("twice", "SELECT id, id FROM tiny_rows"),
            ],
        ).collect()
    }
    assert got == {"cast": "error", "zero": "error", "many": "error", "twice": "success"}


@pytest.mark.parametrize("strict", [False, True])
def test_decimals_are_compared_exactly(spark, strict):
    def equal(left, kind_left, right, kind_right):
        a = spark.createDataFrame([(left,)], f"a {kind_left}")
        b = spark.createDataFrame([(right,)], f"b {kind_right}")
        return outcomes.result_sets_equal(a, b, strict).first().equal

    one, two = Decimal("1234567890123456789.01"), Decimal("1234567890123456789.02")
    assert not equal(one, "decimal(21,2)", two, "decimal(21,2)")
    assert equal(one, "decimal(21,2)", one, "decimal(30,6)")
    assert not equal(9007199254740993, "bigint", Decimal(9007199254740992), "decimal(20,0)")
    assert equal(7, "int", Decimal("7.000"), "decimal(38,30)")
    assert equal(True, "boolean", Decimal(1), "decimal(10,2)")
    assert not equal(Decimal("0.10"), "decimal(38,37)", Decimal("1"), "decimal(38,0)")
    assert equal(Decimal("100"), "decimal(38,0)", Decimal("100.0"), "decimal(10,5)")


def test_unknown_outcomes_are_not_kept(rows):
    sql = "SELECT a FROM t WHERE b = {}"
    pairs = rows(
        [(1, sql.format(1), None, True, 3), (2, sql.format(2), True, None, 3), (3, sql.format(3), True, True, None),
         (4, sql.format(1), True, True, 3), (5, sql.format(1), True, True, 3)],
        "pair_id int, sql string, parse_ok boolean, exec_ok boolean, row_count int",
    )
    got = {r.pair_id: r.reason for r in curate.filter_pairs(pairs).collect()}
    assert got == {1: curate.UNPARSABLE, 2: curate.FAILS, 3: curate.FAILS, 4: curate.KEPT, 5: curate.DUPLICATE}


def test_noise_leaves_literals_alone(rows):
    sql = "SELECT name FROM t WHERE kind = 'status' AND status = 1 -- status"
    pairs = rows([(1, "d", "q", sql, "simple")], "pair_id int, db_id string, question string, sql string, difficulty string")
    schema = rows([("d", ["status", "a$1"])], "db_id string, known_columns array<string>")
    (row,) = tasks.noise_correction_task(pairs, schema).collect()
    assert any("kind = 'status' AND a$1 = 1 -- status" in str(v) for v in row.asDict(True).values())


def test_version_sees_moved_nulls_and_large_tables(spark, rows):
    def version(data):
        return records.table_version(rows(data, "a string, b string")).first().version

    assert len({version(d) for d in ([(None, "x")], [("x", None)], [("x", "")], [("", "x")], [("1:x", None)])}) == 5
    assert records.table_version(spark.range(0)).first().version == "0-0"


def test_malformed_files_fail(spark, tmp_path):
    (tmp_path / "query_results_a_seed1.json").write_text('{"1": "SELECT 1"}')
    assert records.load_predictions(spark, str(tmp_path)).count() == 1
    (tmp_path / "query_results_b_seed1.json").write_text('{"1": "SELECT')
    with pytest.raises(Exception, match="query_results_b_seed1"):
        records.load_predictions(spark, str(tmp_path)).collect()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text('{"db_id": "a"}\n{"db_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.load_records(spark, str(tmp_path / "lines"), records.PAIR_SCHEMA, array_file=False).collect()


def test_fingerprint_of_a_folder(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text("one")
        (tmp_path / name / "y").write_text("two")
    (tmp_path / "b" / "y").write_text("three")
    paths = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a" / "x"), str(tmp_path / "none")]
    found = {r.path: r.sha256 for r in records.fingerprint_files(spark, paths).collect()}
    assert found[paths[0]] and found[paths[1]] and found[paths[0]] != found[paths[1]]
    assert found[paths[2]] == "7692c3ad3540bb80" and found[paths[3]] is None


def test_all_training_questions_of_a_leak(rows):
    train = rows([(k, "d", f"q{k}", "SELECT a FROM t WHERE b = 1") for k in range(9)], "pair_id int, db_id string, question string, sql string")
    asked = rows([(1, "d", "select a from t where b=1")], "question_id int, db_id string, gold_sql string")
    assert curate.leak_report(train, asked).count() == 9
    assert curate.leak_counts(train, asked).first().train_hits == 9


def test_numbers_have_one_canonical_text(spark):
    """Pairs of one number in two types, and of two numbers that are close."""
    def texts(sql):
        return {r.row for r in spark.sql(sql).select(outcomes.canonical_row(spark.sql(sql))).collect()}

    same = [
        ("1", "1.0D"), ("TRUE", "1.000BD"), ("CAST(1e17 AS DOUBLE)", "100000000000000000"), ("-0.0D", "0"),
        ("CAST(2.5 AS FLOAT)", "2.50BD"), ("1e-25D", "0.0000000000000000000000001BD"), ("-12300", "-1.23E4D"),
        ("power(2.0D, 60)", "1152921504606846976"), ("power(2.0D, 100)", "1267650600228229401496703205376BD"),
        ("-power(2.0D, 70)", "-1180591620717411303424BD"), ("CAST(16777217 AS FLOAT)", "16777216"),
        ("9007199254740993", "9007199254740993BD"), ("CAST(0.1 AS FLOAT)", "0.1BD"), ("-9223372036854775808L", "-9223372036854775808BD"),
    ]
    other = [
        ("1e-25D", "0.0D"), ("1.2345678901234567E-15D", "1.2345678901234999E-15D"), ("9007199254740993", "9007199254740992"),
        ("power(2.0D, 60)", "1152921504606846977"), ("1", "10"), ("0.1D", "0.01D"), ("-1", "1"), ("'1'", "1"), ("1e300D", "1e301D"),
        ("double('NaN')", "double('Infinity')"), ("double('Infinity')", "double('-Infinity')"), ("NULL", "0"),
    ]
    for pairs, expected in ((same, True), (other, False)):
        for a, b in pairs:
            assert (texts(f"SELECT {a}") == texts(f"SELECT {b}")) is expected, (a, b)


def questions(spark, many, statements):
    """Questions that share a few statements; every third prediction is wrong, every 50th does not run."""
    gold = F.concat(F.lit("SELECT id FROM range("), F.col("id") % statements, F.lit(")"))
    wrong = F.concat(F.lit("SELECT id + 1 FROM range("), F.col("id") % statements + 1, F.lit(")"))
    predicted = F.when(F.col("id") % 50 == 49, "SELECT nothing FROM nowhere").when(F.col("id") % 3 == 0, wrong).otherwise(gold)
    return spark.range(many).select(F.col("id").cast("string").alias("id"), gold.alias("gold_sql"), predicted.alias("predicted_sql"))


def test_many_questions_in_blocks(spark, tmp_path, monkeypatch):
    """20,000 questions on few statements: no more than a block ever reaches the driver."""
    held = []
    inner = outcomes._blocks
    monkeypatch.setattr(outcomes, "_blocks", lambda frame, size: (held.append(len(b)) or b for b in inner(frame, size)))
    asked = questions(spark, 20_000, 7)
    got = outcomes.evaluate(spark, asked, str(tmp_path / "run"), block=4)
    counts = {(r.score, r.failed): r["count"] for r in got.groupBy("score", F.col("error").isNotNull().alias("failed")).count().collect()}
    bad = sum(k % 50 == 49 for k in range(20_000))
    wrong = sum(k % 50 != 49 and k % 3 == 0 for k in range(20_000))
    assert counts == {(0, True): bad, (0, False): wrong, (1, False): 20_000 - bad - wrong}
    assert max(held) <= 4 and sum(held) == 15


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    folder, ran, inner = str(tmp_path / "run"), [], outcomes._run_one

    def counted(session, statement_id, *rest):
        if len(ran) == 5:
            raise KeyboardInterrupt
        ran.append(statement_id)
        return inner(session, statement_id, *rest)

    asked = questions(spark, 60, 6)
    monkeypatch.setattr(outcomes, "_run_one", counted)
    with pytest.raises(BaseException):
        outcomes.evaluate(spark, asked, folder, concurrency=1, block=3).collect()
    before = len(ran)
    monkeypatch.setattr(outcomes, "_run_one", lambda *a: ran.append(a[1]) or inner(*a))
    got = {r.id: r.score for r in outcomes.evaluate(spark, asked, folder, concurrency=1, block=3).collect()}
    assert before == 5 and len(ran) - before == 6
    assert got == {r.id: r.score for r in outcomes.evaluate(spark, asked, str(tmp_path / "whole")).collect()}


def test_timed_repeats_feed_the_score(spark, tmp_path, monkeypatch):
    """Runs take turns, failed runs are left out, and the upper median is taken."""
    ticks = iter(range(100_000))
    order, taken = [], {"SELECT 1 AS a": [5.0, 1.0, 3.0], "SELECT 1 AS b": [2.0, 9.0, None]}
    inner = outcomes._seconds

    def seconds(session, sql, limit, clock):
        order.append(sql)
        assert inner(session, sql, limit, clock) == 1
        return taken[sql].pop(0)

    monkeypatch.setattr(outcomes, "_seconds", seconds)
    asked = [("x", "SELECT 1 AS a", "SELECT 1 AS b"), ("y", "SELECT 1 AS a", "SELECT 2 AS b"), ("z", "ambiguous", "ambiguous"), ("n", "SELECT 1 AS a", None)]
    got = outcomes.evaluate(spark, asked, str(tmp_path), repeats=3, clock=lambda: next(ticks))
    rows = {r.id: r for r in score.with_ratio(got).collect()}
    assert order == ["SELECT 1 AS a", "SELECT 1 AS b"] * 3
    assert (rows["x"].t_gold, rows["x"].t_pred) == (3.0, 9.0) and rows["x"].exec_ratio == pytest.approx((3 / 9) ** 0.5)
    assert [rows[k].score for k in "xyzn"] == [1, 0, 1, 0] and rows["y"].t_gold is None and rows["y"].exec_ratio == 0
    assert rows["n"].error == "no statement"


def test_the_time_limit_counts_a_statement_alone(spark, monkeypatch):
    """A statement held up by others beside it is run again alone; one too slow by itself times out."""
    lock, beside, calls = threading.Lock(), [0], []

    def run(session, statement_id, sql, limit, *rest):
        with lock:
            beside[0] += 1
            calls.append(statement_id)
        time.sleep(0.3)
        with lock:
            crowded, beside[0] = beside[0] > 1, beside[0] - 1
        if crowded or statement_id == "slow":
            return statement_id, "error", None, None, "timeout"
        return statement_id, "success", 1, "a", None

    monkeypatch.setattr(outcomes, "_run_one", run)
    asked = [(name, "SELECT 1 AS a FROM t") for name in ("one", "slow", "two")]
    got = {r.statement_id: (r.status, r.error) for r in outcomes.run_candidates(spark, asked, concurrency=3).collect()}
    assert got == {"one": ("success", None), "two": ("success", None), "slow": ("error", "timeout")}
    assert calls.count("slow") == 2


def test_no_time_limit(spark):
    asked = [("a", "SELECT count(*) AS n FROM range(1000)")]
    assert [r.status for r in outcomes.run_candidates(spark, asked, timeout_seconds=None).collect()] == ["success"]


def test_whole_numbers_and_their_decimals_have_one_text(spark):
    values = [0, 7, -7, 10, -1200, 2**63 - 1, -(2**63), 1000000007]
    df = spark.createDataFrame([(v,) for v in values], "a bigint")
    cell, other = outcomes.canonical_cell(df.schema["a"].dataType, F.col("a")), F.col("a").cast("decimal(19,0)")
    wide = df.select(cell.alias("x"), outcomes.canonical_cell(df.select(other.alias("b")).schema["b"].dataType, other).alias("y"))
    assert all(r.x == r.y for r in wide.collect())


def test_archived_numbers_keep_all_digits(spark, duck):
    """Digits of a double are the shortest that mean it, without a power of ten up to 10^21, as JSON writers print them."""
    values = [0.1, 1e-6, 1.5e-7, 12345678.9, 1e7, 1e15, 1e20, 1e21, 1.23e25, 1e23, 2e-3, 8.41e21, -0.0, 65537.99000000001, 1e-300, 1 / 3, -98765432.109375, None]
    values += [(k * 7919 % 999_983) / 100 * 10.0 ** (k % 17 - 5) + 1 for k in range(400)]
    df = spark.createDataFrame([(k, v, 'a"\\é') for k, v in enumerate(values)], "query_id int, x double, `the \"name` string")
    got = {r.query_id: r.row for r in records.archive_results(df, ["query_id"]).collect()}
    for k, v in enumerate(values):
        want = duck.execute("SELECT CAST(to_json(CAST(? AS DOUBLE)) AS VARCHAR)", [v]).fetchone()[0] or "null"
        assert got[k] == '{"x":' + want + ',"the \\"name":"a\\"\\\\é"}'
    one = spark.createDataFrame([(1, Decimal("12345678.50"), None)], "query_id int, x decimal(18,2), y double")
    assert records.archive_results(one, ["query_id"]).first().row == '{"x":12345678.5,"y":null}'


def test_statements_of_objects_are_those_of_the_parser(spark, rows):
    texts = [
        None, "", "SELECT 1", " \t{\"query\": \"a\"}", "{}", "{", "{oops", '{"query":"}', '{"query":""}', '{"sql":""}', '{"query":"a"}', '{"sql": "b"}',
        '{ "query" : "a b" }', '{"query":"a","sql":"b"}', '{"query":"","sql":"b"}', '{"query":null,"sql":"b"}', '{"query":"a\\"b"}', '{"sql":"\\u0061"}',
        '{"query":"a\\\\"}', '{"query":"a"} x', '{"query":"a"}\n', '{"query":"a\nb"}', '{"query":5}', '{"query":{"sql":"c"}}', '{"other":"a"}', '{"query":"ж 中"}',
        '{"sql":"a","sql":"b"}', "\x0b{\"sql\":\"a\"}", " {\"sql\":\"a\"}", '["query"]', '{"query":"' + "x y " * 50_000 + '"}',
    ]
    value = F.col("v")
    named = [F.nullif(F.get_json_object(value, f"$.{name}"), F.lit("")) for name in ("query", "sql")]
    by_parser = F.when(value.rlike(r"^\s*\{"), F.coalesce(*named, F.lit(""))).otherwise(F.coalesce(value, F.lit("")))
    got = rows([(t,) for t in texts], "v string").select("v", records.prediction_text(value).alias("got"), by_parser.alias("want")).collect()
    assert [(r.v, r.got) for r in got] == [(r.v, r.want) for r in got]


def test_the_name_of_a_prediction_file_is_searched_once_per_map(spark, tmp_path):
    (tmp_path / "query_results_a_seed1.json").write_text('{"1": "SELECT 1", "2": {"sql": "SELECT 2"}}')
    df = records.load_predictions(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("a", 1, "1", "SELECT 1"), ("a", 1, "2", "SELECT 2")]
    above, _, below = df._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert "query_results_" in below and "query_results_" not in above
    # The map is read where it is unfolded and nowhere else.
    assert below.partition("\n")[0].count("from_json") == 1 and "from_json" not in below.partition("\n")[2]
