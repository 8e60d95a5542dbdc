"""SQL-text columns over all statements and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from qloom.functions import text
from qloom.operators import generate
from qloom.suite import fixtures
from qloom.suite.registry import query

P, R = ("f_pairs",), ("f_replies",)
TRIM = r"'^\s+|\s+$', '', 'g'"

EXTRACT = rf"""
t1 AS (SELECT *, regexp_replace(raw, {TRIM}) AS a FROM src),
t2 AS (SELECT *, CASE WHEN regexp_matches(a, '(?is)```(?:sql)?\s*(.*?)```')
       THEN regexp_replace(regexp_extract(a, '(?is)```(?:sql)?\s*(.*?)```', 1), {TRIM}) ELSE a END AS b FROM t1),
t3 AS (SELECT *, CASE WHEN regexp_matches(b, '(?is)\b(?:WITH|SELECT)\b.*$')
       THEN regexp_extract(b, '(?is)\b(?:WITH|SELECT)\b.*$', 0) ELSE b END AS c FROM t2),
done AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(c, {TRIM}), ';+$', ''), {TRIM}) AS sql FROM t3)"""


@query(
    "x1_extract_sql",
    f"WITH src AS (SELECT reply_id, reply AS raw FROM f_replies), {EXTRACT} SELECT reply_id, sql FROM done",
    R,
)
def extract_sql(spark, sf_dir):
    return fixtures.replies(spark, sf_dir).select("reply_id", text.extract_sql(F.col("reply")).alias("sql"))


@query(
    "x2_extract_changed_count",
    f"""WITH src AS (SELECT reply_id, reply AS raw FROM f_replies), {EXTRACT}
SELECT count(*) AS replies, count(*) FILTER (sql <> raw) AS changed FROM done""",
    R,
)
def extract_changed_count(spark, sf_dir):
    changed = text.extract_sql(F.col("reply")) != F.col("reply")
    return fixtures.replies(spark, sf_dir).agg(F.count(F.lit(1)).alias("replies"), F.count_if(changed).alias("changed"))


@query(
    "x3_extract_after_marker",
    f"""WITH src AS (SELECT pair_id, string_split(reasoned, 'SQL:')[-1] AS raw FROM
  (SELECT pair_id, concat('First SELECT the customer. SQL: draft', E'\\nSQL:\\n', sql) AS reasoned FROM f_pairs)), {EXTRACT}
SELECT pair_id, sql FROM done""",
    P,
)
def extract_after_marker(spark, sf_dir):
    reasoned = F.concat(F.lit("First SELECT the customer. SQL: draft\nSQL:\n"), F.col("sql"))
    return fixtures.pairs(spark, sf_dir).select("pair_id", text.extract_after_marker(reasoned).alias("sql"))


@query(
    "x4_strip_comments",
    rf"""
SELECT reply_id, regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(reply, '(?s)/\*.*?\*/', '', 'g'), '--[^\n]*', '', 'g'), {TRIM}),
  '(?i)^```(?:sql)?\s*|\s*```$', '', 'g'), {TRIM}) AS sql FROM f_replies""",
    R,
)
def strip_comments(spark, sf_dir):
    return fixtures.replies(spark, sf_dir).select("reply_id", text.strip_comments(F.col("reply")).alias("sql"))


@query(
    "x5_sanitize_sql",
    r"""
WITH t AS (SELECT pair_id, sql, '(?is)SELECT\s+DISTINCT\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(LIMIT\s+\d+)?;' AS pat
           FROM (SELECT pair_id, replace(sql, 'T1.o_totalprice AS', 'CAST(T1.o_totalprice AS REAL) AS') AS sql FROM f_pairs)),
w AS (SELECT pair_id, CASE WHEN regexp_matches(sql, pat) THEN concat('SELECT * FROM (SELECT DISTINCT ',
        regexp_extract(sql, '(?is)SELECT\s+DISTINCT\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(LIMIT\s+\d+)?;', 1), ' FROM ',
        regexp_extract(sql, '(?is)SELECT\s+DISTINCT\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(LIMIT\s+\d+)?;', 2),
        ') sub ORDER BY ',
        regexp_extract(sql, '(?is)SELECT\s+DISTINCT\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(LIMIT\s+\d+)?;', 3), ' ',
        regexp_extract(sql, '(?is)SELECT\s+DISTINCT\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(LIMIT\s+\d+)?;', 4), ';')
      ELSE sql END AS s FROM t)
SELECT pair_id, regexp_replace(s, '(?i)CAST\(([^\n]*?)\s+AS\s+REAL\)', '\1::REAL', 'g') AS sql FROM w""",
    P,
)
def sanitize_sql(spark, sf_dir):
    cast = F.replace("sql", F.lit("T1.o_totalprice AS"), F.lit("CAST(T1.o_totalprice AS REAL) AS"))
    return fixtures.pairs(spark, sf_dir).select("pair_id", text.sanitize_sql(cast).alias("sql"))


CUT = "CASE pair_id % 3 WHEN 0 THEN 'WHERE' WHEN 1 THEN 'ON' ELSE 'zzz' END"


@query(
    "x6_is_complete",
    f"""
WITH t AS (SELECT pair_id, upper(regexp_replace(CASE WHEN strpos(sql, {CUT}) > 0
  THEN substr(sql, 1, strpos(sql, {CUT}) + length({CUT}) - 1) ELSE sql END, {TRIM})) AS s FROM f_pairs)
SELECT pair_id, contains(s, 'SELECT') AND contains(s, 'FROM') AND NOT regexp_matches(s, '(?:WHERE|JOIN|FROM|ON|AND|OR)$')
  AS complete FROM t""",
    P,
)
def is_complete(spark, sf_dir):
    word, at = F.expr(CUT), F.expr(f"instr(sql, {CUT})")
    cut = F.when(at > 0, F.substring(F.col("sql"), F.lit(1), at + F.length(word) - 1)).otherwise(F.col("sql"))
    return fixtures.pairs(spark, sf_dir).select("pair_id", text.is_complete(cut).alias("complete"))


VERBS = (
    "CASE pair_id % 5 WHEN 0 THEN concat(sql, ' DROP TABLE orders') WHEN 1 THEN concat(sql, ' -- update later') "
    "WHEN 2 THEN replace(sql, 'WHERE', 'WHERE ''delete'' <> ''insert'' AND') "
    "WHEN 3 THEN concat('insert into t ', sql) ELSE sql END"
)


@query(
    "x7_read_only",
    rf"""
SELECT pair_id, NOT regexp_matches(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  {VERBS}, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '''[^'']*''', '''''', 'g'), '"[^"]*"', ' ', 'g'),
  '(?i)\b(?:DROP|DELETE|UPDATE|CREATE|INSERT|ALTER)\b') AS read_only FROM f_pairs""",
    P,
)
def read_only(spark, sf_dir):
    risky = fixtures.pairs(spark, sf_dir).selectExpr("pair_id", VERBS.replace("''", "\\'") + " AS sql")
    return risky.select("pair_id", text.is_read_only(F.col("sql")).alias("read_only"))


NORMALIZED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, {TRIM}),
  '(?i)^```(?:sql)?|```$', '', 'g'), {TRIM}), ';+$', ''), {TRIM})"""


@query("x8_normalize_sql", f"SELECT pair_id, {NORMALIZED} AS sql FROM f_pairs", P)
def normalize_sql(spark, sf_dir):
    return fixtures.pairs(spark, sf_dir).select("pair_id", text.normalize_sql(F.col("sql")).alias("sql"))


@query(
    "x9_fingerprint",
    rf"""SELECT regexp_replace(regexp_replace(lower(sql), '\s+', ' ', 'g'), {TRIM}) AS fingerprint, count(*) AS n
FROM f_pairs GROUP BY 1""",
    P,
)
def fingerprint(spark, sf_dir):
    keyed = fixtures.pairs(spark, sf_dir).select(text.fingerprint(F.col("sql")).alias("fingerprint"))
    return keyed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def leak_key_sql(column: str) -> str:
    expression = f"lower({column})"
    for pattern, replacement in text.LEAK_KEY_STEPS:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({expression}, {TRIM})"


@query(
    "x10_norm_sql",
    f"""SELECT pair_id AS id, 'train' AS side, {leak_key_sql('sql')} AS key FROM f_pairs UNION ALL
SELECT question_id, 'eval', {leak_key_sql('gold_sql')} FROM f_eval""",
    ("f_pairs", "f_eval"),
)
def norm_sql(spark, sf_dir):
    train = fixtures.pairs(spark, sf_dir).select(
        F.col("pair_id").alias("id"), F.lit("train").alias("side"), text.leak_key(F.col("sql")).alias("key")
    )
    asked = fixtures.eval_set(spark, sf_dir).select(
        F.col("question_id").alias("id"), F.lit("eval").alias("side"), text.leak_key(F.col("gold_sql")).alias("key")
    )
    return train.unionByName(asked)


STARRED = (
    "CASE pair_id % 4 WHEN 0 THEN 'SELECT * FROM orders' WHEN 1 THEN 'SELECT count(*) FROM orders' "
    "WHEN 2 THEN concat('SELECT * FROM orders LIMIT ', CAST(pair_id AS {text})) ELSE sql END"
)


@query(
    "x11_is_trivial",
    rf"""WITH t AS (SELECT pair_id, {STARRED.format(text='VARCHAR')} AS s FROM f_pairs)
SELECT pair_id, regexp_matches(s, '(?is)(?:\bselect\s+(?:all\s+|distinct\s+)?|,\s*|\.)\*')
  AND NOT regexp_matches(s, '(?i)\b(?:where|group|join|order)\b')
  AND NOT regexp_matches(s, '(?i)\b(?:count|sum|avg|min|max)\s*\(') AS trivial FROM t""",
    P,
)
def is_trivial(spark, sf_dir):
    starred = fixtures.pairs(spark, sf_dir).selectExpr("pair_id", STARRED.format(text="STRING") + " AS sql")
    return starred.select("pair_id", text.is_trivial(F.col("sql")).alias("trivial"))


@query(
    "x12_compare_norm",
    rf"""SELECT question_id, arm, seed, lower(regexp_replace(regexp_replace(regexp_replace(
  coalesce(nullif(predicted_sql, 'error'), ''), {TRIM}), ';+$', ''), '\s+', ' ', 'g')) AS text FROM f_scores""",
    ("f_scores",),
)
def compare_norm(spark, sf_dir):
    said = F.nullif("predicted_sql", F.lit("error"))
    return fixtures.scores(spark, sf_dir).select("question_id", "arm", "seed", text.comparable(said).alias("text"))


BATCH = (
    "CASE pair_id % 3 WHEN 0 THEN concat('Here are the pairs: [{{\"question\": \"', question, '\", \"sql\": \"', sql, "
    "'\"}}, {{\"question\": \"\", \"sql\": \"SELECT 1\"}}] Good luck.') "
    "WHEN 1 THEN concat('see [1]: [{{\"question\": \"', question, '\", \"sql\": \"', sql, '\"}}]') "
    "ELSE 'No pairs today [' END"
)


@query(
    "x13_parse_pair_batch",
    """SELECT pair_id, question, sql FROM f_pairs WHERE pair_id % 3 = 0""",
    P,
)
def parse_pair_batch(spark, sf_dir):
    generated = fixtures.pairs(spark, sf_dir).selectExpr("pair_id", BATCH.format() + " AS reply")
    return generate.parse_pair_batch(generated, "reply").select("pair_id", "question", "sql")


@query(
    "x14_clean_fence_edges",
    rf"""WITH t AS (SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN concat(E'```sql\n', sql, E'\n```')
  WHEN 1 THEN concat('```', sql) ELSE sql END AS reply FROM f_pairs)
SELECT pair_id, regexp_replace(regexp_replace(regexp_replace(reply, {TRIM}), '(?i)^```(?:sql)?|```$', '', 'g'), {TRIM}) AS sql
FROM t""",
    P,
)
def clean_fence_edges(spark, sf_dir):
    fenced = (
        F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("```sql\n"), "sql", F.lit("\n```")))
        .when(F.col("pair_id") % 3 == 1, F.concat(F.lit("```"), "sql"))
        .otherwise(F.col("sql"))
    )
    return fixtures.pairs(spark, sf_dir).select("pair_id", text.clean_fence_edges(fenced).alias("sql"))
