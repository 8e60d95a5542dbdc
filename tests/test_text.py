from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qloom.functions import text, tokens
from qloom.operators import generate


@pytest.fixture
def apply(spark):
    """Value of a text function for each input."""

    def run(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        out = [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]
        return out[0] if len(out) == 1 else out

    return run


def test_extract_sql_takes_first_fence_and_cuts_prose(apply):
    assert apply(
        text.extract_sql,
        "Use:\n```sql\nSELECT 1;\n```\nor ```SELECT 2```",
        "To find it: with t as (select 1) select * from t ;; ",
        "no statement here",
        "```\n\n```",
        "```\nEXPLAIN x\nselect 2\n```",
    ) == ["SELECT 1", "with t as (select 1) select * from t", "no statement here", "", "select 2"]


def test_extract_sql_needs_a_word_boundary(apply):
    assert apply(text.extract_sql, "selected rows; without SELECT a FROM t") == "SELECT a FROM t"


def test_extract_after_last_marker(apply):
    assert apply(text.extract_after_marker, "SELECT in thought SQL: x SQL:\nSELECT 2;") == "SELECT 2"


def test_strip_comments(apply):
    assert apply(text.strip_comments, "```sql\nSELECT a -- one\nFROM /* two\nlines */ t\n```") == "SELECT a \nFROM  t"


def test_sanitize_rewrites(apply):
    assert apply(
        text.sanitize_sql,
        "```sql\nSELECT DISTINCT a FROM t ORDER BY b LIMIT 3;\n```",
        "SELECT DISTINCT a FROM t ORDER BY b LIMIT 3",
        "SELECT CAST(x AS REAL) / NULLIF(NULLIF,0)(y)",
        "a\n\n \nb",
    ) == [
        "SELECT * FROM (SELECT DISTINCT a FROM t) sub ORDER BY b  LIMIT 3;",  # the clause keeps its own space
        "SELECT DISTINCT a FROM t ORDER BY b LIMIT 3",
        "SELECT x::REAL / NULLIF(y,0)",
        "a\nb",
    ]


def test_is_complete_looks_at_the_last_characters(apply):
    assert apply(
        text.is_complete,
        "select a from t where",
        "SELECT a FROM person",
        "SELECT 1",
        "SELECT a FROM t WHERE b = 1",
    ) == [False, False, False, True]


def test_read_only_ignores_comments_literals_and_names(apply):
    assert apply(
        text.is_read_only,
        "SELECT 'drop table' AS x -- delete",
        'SELECT "update" FROM t',
        "WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d",
        "SELECT updated_at FROM t /* insert */",
        "alter table t add c int",
    ) == [True, True, False, True, False]


def test_normalize_is_not_idempotent_but_fingerprint_is(apply):
    once = apply(text.normalize_sql, "a ; ;")
    assert once == "a ;"
    assert apply(text.normalize_sql, once) == "a"
    key = apply(text.fingerprint, " SELECT\n  1 ")
    assert key == "select 1" and apply(text.fingerprint, key) == key


def test_leak_key_ignores_aliases_and_keeps_literals(apply):
    a, b, c = apply(
        text.leak_key,
        "SELECT DISTINCT T1.name AS n FROM person AS T1 INNER JOIN city ON T1.id = city.id WHERE (T1.age > 30);",
        "select name from person join city on id=id where age>30",
        "select name from person join city on id=id where age>31",
    )
    assert a == b != c


def test_leak_key_quirks(apply):
    assert apply(text.leak_key, "SELECT 'ABC', CAST(x AS REAL), 'a.b'") == "select 'abc',cast x,'b'"


def test_leak_key_is_that_of_its_steps(apply):
    """Marks that let most texts skip a pattern change no key."""

    def plainly(sql):
        key = F.lower(sql)
        for pattern, replacement in text.LEAK_KEY_STEPS:
            key = F.regexp_replace(key, F.lit(pattern), F.lit(replacement))
        return text.strip(key)

    parts = ["SELECT", " distinct ", "a.b", " as ", "AS x", "(", ")", ";", "```sql", "```", " inner  join ", "\n\t", "=", " < ", ",", "'as. distinct'", "has", "x.y.z", "1.5", "was.as"]
    values = ["".join(parts[(7 * k * k + j * (k + 3)) % len(parts)] for j in range(9)) for k in range(300)] + [None, ""]
    assert apply(text.leak_key, *values) == apply(plainly, *values)


def test_is_trivial(apply):
    assert apply(
        text.is_trivial,
        "SELECT * FROM t",
        "SELECT t.* FROM t LIMIT 5",
        "SELECT * FROM t WHERE a = 1",
        "SELECT count(*) FROM t",
        "SELECT a * 2 FROM t",
        "SELECT * FROM a, b",
        "SELECT '*' FROM t",
    ) == [True, True, False, False, False, False, False]


def test_comparable_treats_null_as_empty(apply):
    assert apply(text.comparable, None, " SELECT  1 ; ", "select 1") == ["", "select 1 ", "select 1"]


def test_join_keys_resolve_aliases(apply):
    assert apply(
        text.join_keys,
        "SELECT 1 FROM posts AS p JOIN users u ON p.owner = u.id LEFT JOIN votes ON votes.user_id = u.id",
        "SELECT 1 FROM a JOIN b ON a.x = b.y AND a.x = a.z AND c.q = b.y WHERE b.t = 'a.x = b.y'",
        "SELECT 1 FROM t x JOIN t y ON x.a = y.b",
    ) == [["posts.owner = users.id", "users.id = votes.user_id"], ["a.x = b.y"], []]


def test_tables_without_alias_before_keywords(apply):
    assert apply(text.accessed_tables, 'select * from B join a on a.x = b.x inner join "C" where 1=1') == ["a", "b", "c"]


def test_non_ascii_names_survive(apply):
    assert apply(text.fingerprint, "SELECT имя FROM Таблица") == "select имя from таблица"


def test_verdict(apply):
    got = apply(lambda c: text.verdict(c, "clear", "ambiguous"), "OK", " ok\n", "Which year?", None)
    assert [(g["status"], g["reason"]) for g in got] == [
        ("clear", None),
        ("clear", None),
        ("ambiguous", "Which year?"),
        ("error", None),
    ]


def test_truncate_keeps_the_limit(apply):
    assert apply(text.truncate_text, "x" * 120, "x" * 121) == ["x" * 120, "x" * 120 + "..."]


def test_token_count(apply):
    assert apply(tokens.token_count, "SELECT a, b.c FROM t;", "", None) == [9, 0, 0]


def test_token_count_with_encoder(apply):
    assert apply(tokens.token_count_with(lambda: str.split), "a b  c", None) == [3, 0]


@pytest.mark.parametrize(
    "reply, expected",
    [
        ('[{"question": "q", "sql": "s"}]', [("q", "s")]),
        ('see [1] and [{"question": "q", "sql": "s"}]', []),
        ('bad [ then [{"question": "q", "sql": "s"}, 3, {"sql": "t"}] and [2]', [("q", "s")]),
        ('[{"question": "q [x]", "sql": "s"}]', [("q [x]", "s")]),
        ("nothing", []),
        (None, []),
    ],
)
def test_parse_pair_batch(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert [(r.question, r.sql) for r in generate.parse_pair_batch(df).collect()] == expected


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aSELECTWITH`; \n\tsql.", max_size=40), min_size=1, max_size=20))
def test_extract_sql_against_plain_rules(spark, replies):
    """The column form agrees with the rules written out for one string."""

    def one(reply):
        value = reply.strip(" \n\t")
        fence = re.search(r"```(?:sql)?\s*(.*?)```", value, re.S | re.I)
        value = fence.group(1).strip(" \n\t") if fence else value
        start = re.search(r"\b(?:WITH|SELECT)\b", value, re.I)
        value = value[start.start() :] if start else value
        return value.strip(" \n\t").rstrip(";").strip(" \n\t")

    df = spark.createDataFrame(list(enumerate(replies)), "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(text.extract_sql(F.col("v"))).collect()]
    assert got == [one(r) for r in replies]
