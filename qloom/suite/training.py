"""Auxiliary tasks, chat text, prompts and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from qloom.operators import curate, tasks
from qloom.suite import fixtures
from qloom.suite.mining import KNOWN, NAMES, schema
from qloom.suite.profiling import compact_schema
from qloom.suite.registry import ORACLES, query, table

P = ("f_pairs",)
DB_LINE = "'Database `' || db_id || '`. "

LINKED = rf"""
used AS (SELECT *, list_sort(list_distinct({NAMES})) AS t,
  list_sort(list_intersect({KNOWN}, regexp_extract_all(sql, '(?i)\b[a-z_]\w*\b'))) AS c FROM src),
linking AS (SELECT pair_id, db_id, 'schema_linking' AS task,
  {DB_LINE}List the tables and columns the question needs.' AS system, question AS user,
  'tables: ' || array_to_string(t, ', ') || E'\ncolumns: ' || array_to_string(c, ', ') AS target, 'derived' AS source
  FROM used WHERE len(t) > 0 AND len(c) > 0)"""
NOISE = rf"""
u2 AS (SELECT *, list_sort(list_intersect({KNOWN}, regexp_extract_all(sql, '(?i)\b[a-z_]\w*\b'))) AS c FROM src2),
v AS (SELECT *, substr(list_sort(list_transform(c, lambda x: md5('0|victim|' || pair_id || '|' || x) || x))[1], 33) AS victim FROM u2),
o AS (SELECT *, substr(list_sort(list_transform(list_filter({KNOWN}, lambda x: x <> victim),
   lambda x: md5('0|other|' || pair_id || '|' || x) || x))[1], 33) AS other FROM v),
b AS (SELECT *, regexp_replace(sql, '\b' || victim || '\b', other) AS broken FROM o),
noise AS (SELECT pair_id, db_id, 'noise_correction' AS task,
  {DB_LINE}One column of this statement is wrong. Answer with the right statement.' AS system,
  'question: ' || question || E'\nSQL: ' || broken AS user, sql AS target, 'derived' AS source
  FROM b WHERE lower(broken) <> lower(sql))"""
CLAUSE = r"(?i)\s+(?:WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT)\s+"
CONT = rf"""
k AS (SELECT *, regexp_extract_all(sql, '{CLAUSE}', 0) AS kw, string_split_regex(sql, '{CLAUSE}') AS pieces FROM src3),
m AS (SELECT *, length(array_to_string(pieces[1:len(kw) // 2 + 1], '')) +
   CASE WHEN len(kw) // 2 = 0 THEN 0 ELSE length(array_to_string(kw[1:len(kw) // 2], '')) END AS cut FROM k WHERE len(kw) > 0),
cont AS (SELECT pair_id, db_id, 'continuation_writing' AS task,
  {DB_LINE}Finish the statement. Answer with the missing part.' AS system,
  'question: ' || question || E'\nSQL so far: ' || trim(substr(sql, 1, cut)) AS user, trim(substr(sql, cut + 1)) AS target,
  'derived' AS source FROM m)"""


@query("c12_schema_linking_task", f"WITH src AS (SELECT * FROM f_pairs), {LINKED} SELECT * FROM linking", P)
def schema_linking_task(spark, sf_dir):
    return tasks.schema_linking_task(fixtures.pairs(spark, sf_dir), schema(spark, sf_dir))


@query("c13_noise_correction_task", f"WITH src2 AS (SELECT * FROM f_pairs), {NOISE} SELECT * FROM noise", P)
def noise_correction_task(spark, sf_dir):
    return tasks.noise_correction_task(fixtures.pairs(spark, sf_dir), schema(spark, sf_dir))


@query("c14_continuation_task", f"WITH src3 AS (SELECT * FROM f_pairs), {CONT} SELECT * FROM cont", P)
def continuation_task(spark, sf_dir):
    return tasks.continuation_task(fixtures.pairs(spark, sf_dir))


def sampled(task):
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id
      ORDER BY md5(concat('0|{task}|', CAST(pair_id AS VARCHAR)))) AS srn, count(*) OVER (PARTITION BY db_id) AS n
      FROM train) WHERE srn <= round_even(n * 0.5, 0))"""


@query(
    "c15_derive_tasks",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY md5(concat('0|', CAST(pair_id AS VARCHAR)))) AS rn,
    count(*) OVER (PARTITION BY db_id) AS cnt FROM f_pairs),
train AS (SELECT pair_id, db_id, question, sql FROM ranked WHERE rn > greatest(1, round_even(cnt * 0.15, 0)) AND db_id <> 'db_P'),
src AS {sampled('schema_linking')}, src2 AS {sampled('noise_correction')}, src3 AS {sampled('continuation_writing')},
{LINKED}, {NOISE}, {CONT}
SELECT pair_id, db_id, task, target FROM linking UNION ALL SELECT pair_id, db_id, task, target FROM noise
UNION ALL SELECT pair_id, db_id, task, target FROM cont""",
    P,
)
def derive_tasks(spark, sf_dir):
    train = curate.stratified_split(fixtures.pairs(spark, sf_dir)).filter("split = 'train'")
    profiled = schema(spark, sf_dir).filter("db_id <> 'db_P'")
    return tasks.derive_tasks(train, profiled).select("pair_id", "db_id", "task", "target")


REASONING = "CASE WHEN pair_id % 5 = 0 THEN '  ' WHEN pair_id % 7 = 0 THEN NULL ELSE ' 1. Find the customer. ' END"


@query(
    "c16_assemble_reasoning",
    f"""WITH t AS (SELECT *, trim({REASONING}) AS r FROM f_pairs)
SELECT pair_id, r || E'\\nSQL:\\n' || sql AS target, 'reasoning_sql' AS task FROM t WHERE coalesce(r, '') <> ''""",
    P,
)
def assemble_reasoning(spark, sf_dir):
    pairs = fixtures.pairs(spark, sf_dir).withColumn("reasoning", F.expr(REASONING))
    return tasks.assemble_reasoning(pairs).select("pair_id", "target", "task")


@query(
    "c17_render_chat",
    f"""WITH src3 AS (SELECT * FROM f_pairs), {CONT},
own AS (SELECT pair_id, 'sql_generation' AS task, {DB_LINE}Answer with one SQL statement.' AS system, question AS user, sql AS target
        FROM f_pairs UNION ALL SELECT pair_id, task, system, user, target FROM cont)
SELECT pair_id, task, E'<|system|>\\n' || system || E'\\n<|user|>\\n' || "user" || E'\\n<|assistant|>\\n' || target || '<|end|>' AS text
FROM own""",
    P,
)
def render_chat(spark, sf_dir):
    pairs = fixtures.pairs(spark, sf_dir)
    plain = curate.tag_source(pairs, "synthetic").select("pair_id", "db_id", "task", "question", "sql")
    records = plain.unionByName(tasks.continuation_task(pairs), allowMissingColumns=True)
    return tasks.render_chat(records).select("pair_id", "task", "text")


@query(
    "c17_render_turns",
    "SELECT conv_id, turn, '<|' || role || E'|>\\n' || text || E'\\n' AS rendered FROM conversations",
)
def render_turns(spark, sf_dir):
    return tasks.render_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "rendered")


@query(
    "c18_build_prompts",
    f"""WITH s AS (SELECT text FROM ({ORACLES['p14_compact_schema']})),
q AS (SELECT o_orderkey AS question_id, 'db_' || o_orderstatus AS db_id, 'Spend of customer ' || o_custkey AS question
      FROM orders)
SELECT question_id, {DB_LINE}Answer with one SQL statement.' || E'\\n\\nSchema:\\n' ||
  CASE WHEN db_id = 'db_P' THEN '' ELSE s.text END AS system,
  'Question: ' || question || E'\\nHint: ' AS "user" FROM q, s""",
)
def build_prompts(spark, sf_dir):
    names = F.explode(F.array(F.lit("db_F"), F.lit("db_O")))
    schemas = compact_schema(spark, sf_dir).withColumn("db_id", names)
    prompts = tasks.build_prompts(fixtures.eval_set(spark, sf_dir), schemas)
    return prompts.select("question_id", "system", "user")


@query(
    "c18_build_prompts_without_schema",
    f"""SELECT question_id, {DB_LINE}Answer with one SQL statement.' AS system,
'Question: ' || question || E'\\nHint: ' AS "user" FROM f_eval""",
    ("f_eval",),
)
def build_prompts_without_schema(spark, sf_dir):
    return tasks.build_prompts(fixtures.eval_set(spark, sf_dir)).select("question_id", "system", "user")


@query(
    "c19_fewshot",
    """WITH d AS (SELECT DISTINCT db_id FROM f_eval),
r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY md5(concat('0|', CAST(pair_id AS VARCHAR)))) AS rn
      FROM f_pairs WHERE db_id <> 'db_P'),
t AS (SELECT db_id, E'Examples:\\n' || string_agg('  Q: ' || question || E'\\n  SQL: ' || sql, E'\\n' ORDER BY rn) || E'\\n' AS text
      FROM r WHERE rn <= 3 GROUP BY db_id)
SELECT db_id, coalesce(text, '') AS text FROM d LEFT JOIN t USING (db_id)""",
    ("f_pairs", "f_eval"),
)
def fewshot(spark, sf_dir):
    databases = fixtures.eval_set(spark, sf_dir).select("db_id").distinct()
    return tasks.fewshot(fixtures.pairs(spark, sf_dir).filter("db_id <> 'db_P'"), databases)


THEMES = ("filters", "aggregates", "joins", "rankings", "joined aggregates", "ratios")
TABLE_NAMES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
TABLE_LIST = "[" + ", ".join(f"'{t}'" for t in TABLE_NAMES) + "]"


@query(
    "c20_request_plan",
    f"""WITH d AS (SELECT db_id, count(*) AS target FROM f_pairs GROUP BY db_id),
r AS (SELECT db_id, unnest(range(0, CAST(ceil(target / 8) AS BIGINT))) AS request FROM d)
SELECT db_id, request, [{', '.join(f"'{t}'" for t in THEMES)}][request % 6 + 1] AS theme,
  array_to_string(list_transform(list_sort(list_transform({TABLE_LIST},
    lambda x: md5('0|' || db_id || '|' || request || '|' || x) || x))[1:3], lambda x: substr(x, 33)), ', ') AS focus FROM r""",
    P,
)
def request_plan(spark, sf_dir):
    databases = (
        fixtures.pairs(spark, sf_dir)
        .groupBy("db_id")
        .agg(F.count(F.lit(1)).alias("target"))
        .withColumn("tables", F.array(*[F.lit(t) for t in TABLE_NAMES]))
    )
    return tasks.request_plan(databases, THEMES)


TOKENS = r"CAST(len(regexp_extract_all(text, '\w+|[^\w\s]')) AS BIGINT)"


@query(
    "c21_token_limit",
    f"SELECT doc_id, {TOKENS} AS tokens, {TOKENS} > 512 AS too_long FROM documents",
)
def token_limit(spark, sf_dir):
    return tasks.token_limit(table(spark, sf_dir, "documents")).select("doc_id", "tokens", "too_long")


@query(
    "c21_too_long_share",
    f"""WITH t AS (SELECT lang, {TOKENS} > 640 AS too_long FROM documents)
SELECT lang, count(*) AS records, count(*) FILTER (too_long) AS too_long,
       round(100.0 * count(*) FILTER (too_long) / count(*), 4) AS share FROM t GROUP BY lang""",
)
def too_long_share(spark, sf_dir):
    flagged = tasks.token_limit(table(spark, sf_dir, "documents"), limit=tasks.REASONING_TOKEN_LIMIT)
    return tasks.too_long_share(flagged, "lang")
