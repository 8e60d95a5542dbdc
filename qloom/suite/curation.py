"""Filters, duplicates, leaks, splits and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from qloom.operators import curate, overlap
from qloom.plans import cut_lineage
from qloom.suite import fixtures
from qloom.suite.registry import query, table
from qloom.suite.sqltext import NORMALIZED, TRIM, leak_key_sql

P, PE = ("f_pairs",), ("f_pairs", "f_eval")

JUDGED = rf"""
n AS (SELECT * REPLACE ({NORMALIZED} AS sql) FROM f_pairs),
k AS (SELECT *, regexp_replace(lower(sql), '\s+', ' ', 'g') AS fp, sql LIKE 'SELECT * FROM%' AS trivial FROM n),
f AS (SELECT *, min(CASE WHEN parse_ok AND NOT trivial AND exec_ok AND row_count > 0 THEN pair_id END)
        OVER (PARTITION BY fp) AS first_kept FROM k),
judged AS (SELECT *, CASE WHEN NOT parse_ok THEN 'unparsable' WHEN trivial THEN 'trivial'
   WHEN first_kept < pair_id THEN 'duplicate' WHEN NOT exec_ok THEN 'fails to run'
   WHEN row_count = 0 THEN 'empty' ELSE 'kept' END AS reason FROM f)"""

# Every 40th statement becomes a bare star query, so the trivial rule has work to do.
STARS = "CASE WHEN pair_id % 40 = 0 THEN 'SELECT * FROM orders' ELSE sql END"
JUDGED_STARS = JUDGED.replace("FROM f_pairs)", f"FROM (SELECT * REPLACE ({STARS} AS sql) FROM f_pairs))")


def raw_pairs(spark, sf_dir):
    return fixtures.pairs(spark, sf_dir).withColumn("sql", F.expr(STARS))


def judged(spark, sf_dir):
    return curate.filter_pairs(raw_pairs(spark, sf_dir))


@query("c1_filter_pairs", f"WITH {JUDGED_STARS} SELECT pair_id, db_id, sql, reason FROM judged", P)
def filter_pairs(spark, sf_dir):
    return judged(spark, sf_dir).select("pair_id", "db_id", "sql", "reason")


@query(
    "c2_reject_report",
    f"""WITH {JUDGED_STARS}, c AS (SELECT db_id, reason, count(*) AS n FROM judged GROUP BY ALL)
SELECT db_id, reason, n, round(100.0 * n / sum(n) OVER (PARTITION BY db_id), 4) AS share FROM c""",
    P,
)
def reject_report(spark, sf_dir):
    return curate.reject_report(judged(spark, sf_dir), by=["db_id"])


@query(
    "c2_kept_by_difficulty",
    f"""WITH {JUDGED_STARS} SELECT coalesce(difficulty, 'unknown') AS difficulty, count(*) AS kept FROM judged
WHERE reason = 'kept' GROUP BY 1""",
    P,
)
def kept_by_difficulty(spark, sf_dir):
    return curate.kept_by_difficulty(judged(spark, sf_dir))


MESSAGE = (
    "CASE WHEN exec_ok THEN NULL WHEN pair_id % 3 = 0 THEN '(psycopg.errors.UndefinedColumn) column does not exist' "
    "WHEN pair_id % 3 = 1 THEN '(psycopg.errors.SyntaxError) syntax error' ELSE 'connection lost' END"
)


@query(
    "c3_error_taxonomy",
    rf"""WITH t AS (SELECT {MESSAGE} AS error FROM f_pairs)
SELECT CASE WHEN regexp_extract(error, 'errors\.(\w+)', 1) = '' THEN 'other'
       ELSE regexp_extract(error, 'errors\.(\w+)', 1) END AS error_class, count(*) AS n
FROM t WHERE error IS NOT NULL GROUP BY 1""",
    P,
)
def error_taxonomy(spark, sf_dir):
    return curate.error_taxonomy(fixtures.pairs(spark, sf_dir).withColumn("error", F.expr(MESSAGE)))


LEAKS = f"""
ek AS (SELECT db_id, {leak_key_sql('gold_sql')} AS key, max(question_id) AS question_id FROM f_eval
       WHERE db_id <> 'db_P' GROUP BY ALL),
tk AS (SELECT *, {leak_key_sql("replace(sql, 'AS price', '')")} AS key FROM f_pairs),
leaks AS (SELECT tk.*, ek.question_id FROM tk JOIN ek USING (db_id, key))"""


def train_rows(spark, sf_dir):
    return fixtures.pairs(spark, sf_dir).withColumn("sql", F.replace("sql", F.lit("AS price"), F.lit("")))


def asked(spark, sf_dir):
    return curate.filter_databases(fixtures.eval_set(spark, sf_dir), ["db_F", "db_O"])


@query("c4_find_leaks", f"WITH {LEAKS} SELECT pair_id, db_id, question_id FROM leaks", PE)
def find_leaks(spark, sf_dir):
    return curate.find_leaks(train_rows(spark, sf_dir), asked(spark, sf_dir)).select("pair_id", "db_id", "question_id")


@query("c5_leak_report", f"WITH {LEAKS} SELECT question_id, pair_id, question AS train_question FROM leaks", PE)
def leak_report(spark, sf_dir):
    return curate.leak_report(train_rows(spark, sf_dir), asked(spark, sf_dir))


@query("c5_leak_counts", f"WITH {LEAKS} SELECT question_id, count(*) AS train_hits FROM leaks GROUP BY question_id", PE)
def leak_counts(spark, sf_dir):
    return curate.leak_counts(train_rows(spark, sf_dir), asked(spark, sf_dir))


@query(
    "c5_leak_totals",
    f"""WITH {LEAKS}
SELECT (SELECT count(*) FROM f_eval WHERE db_id <> 'db_P') AS eval_questions, (SELECT count(*) FROM f_pairs) AS train_pairs,
       count(DISTINCT question_id) AS contaminated, count(*) AS leaking_pairs,
       count(DISTINCT question_id) = 0 AS passed FROM leaks""",
    PE,
)
def leak_totals(spark, sf_dir):
    return curate.leak_totals(train_rows(spark, sf_dir), asked(spark, sf_dir))


@query(
    "c6_drop_leaks",
    f"WITH {LEAKS} SELECT pair_id, db_id FROM tk WHERE pair_id NOT IN (SELECT pair_id FROM leaks)",
    PE,
)
def drop_leaks(spark, sf_dir):
    return curate.drop_leaks(train_rows(spark, sf_dir), asked(spark, sf_dir)).select("pair_id", "db_id")


@query(
    "c7_ngram_overlap",
    rf"""
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(lower(text), {TRIM}), '\s+') AS w FROM documents),
b AS (SELECT item_id, string_split_regex(regexp_replace(lower(text), {TRIM}), '\s+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g
       FROM d WHERE len(w) >= 4),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g
       FROM b WHERE len(w) >= 4),
bt AS (SELECT item_id, count(*) AS total FROM bs GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared, total, round(shared / total, 6) AS overlap
FROM s JOIN bt USING (item_id) WHERE shared >= ceil(round(total * 0.9, 9))""",
)
def ngram_overlap(spark, sf_dir):
    return overlap.ngram_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SPLIT = """
r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY md5(concat('0|', CAST(pair_id AS VARCHAR)))) AS rn,
             count(*) OVER (PARTITION BY db_id) AS cnt FROM f_pairs),
split AS (SELECT *, CASE WHEN rn <= greatest(1, round_even(cnt * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM r)"""


@query("c8_stratified_split", f"WITH {SPLIT} SELECT pair_id, db_id, split FROM split", P)
def stratified_split(spark, sf_dir):
    return curate.stratified_split(fixtures.pairs(spark, sf_dir)).select("pair_id", "db_id", "split")


@query(
    "c9_nested_sizes",
    """WITH r AS (SELECT pair_id, row_number() OVER (ORDER BY md5(concat('0|', CAST(pair_id AS VARCHAR)))) AS rn FROM f_pairs)
SELECT variant, pair_id FROM r JOIN (VALUES (50::BIGINT), (143), (347), (1171)) v(variant) ON rn <= variant""",
    P,
)
def nested_sizes(spark, sf_dir):
    return curate.nested_sizes(fixtures.pairs(spark, sf_dir), [50, 143, 347, 1171]).select("variant", "pair_id")


_CELL = "coalesce(concat(length(CAST({0} AS VARCHAR)), ':', {0}), '-')"


def _version(name, view, columns):
    return f"""SELECT 'source', concat('{name} ', sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)), '-', sum(CAST(concat('0x', substr(h, 17, 15)) AS BIGINT))), count(*)
FROM (SELECT md5(concat_ws('|', {", ".join(_CELL.format(c) for c in columns)})) AS h FROM {view})"""


TRAIN_COLUMNS, EVAL_COLUMNS = ("pair_id", "db_id", "question", "sql"), ("question_id", "db_id", "gold_sql")


@query(
    "c10_manifest",
    f"""WITH {LEAKS},
clean AS (SELECT * FROM tk WHERE pair_id NOT IN (SELECT pair_id FROM leaks)),
{SPLIT.replace("FROM f_pairs", "FROM clean")},
t AS (SELECT db_id, coalesce(difficulty, 'unknown') AS difficulty, 'sql_generation' AS task, split FROM split)
SELECT 'by_db' AS section, db_id AS name, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT 'by_difficulty', difficulty, count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'by_task', task, count(*) FROM t WHERE split = 'train' GROUP BY ALL
UNION ALL SELECT 'total', concat('n_', split), count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'total', 'eval_leaks_removed', count(DISTINCT pair_id) FROM leaks
UNION ALL {_version("pairs", "f_pairs", TRAIN_COLUMNS)}
UNION ALL {_version("questions", "f_eval", EVAL_COLUMNS)}""",
    PE,
)
def manifest(spark, sf_dir):
    pairs, questions = train_rows(spark, sf_dir), asked(spark, sf_dir)
    # Kept narrow and once: the split and the counts read these rows several times.
    marked = cut_lineage(curate.mark_leaks(pairs, questions).select("pair_id", "db_id", "difficulty", "leaks"))
    removed = marked.filter("leaks").agg(F.count_distinct("pair_id")).scalar()
    clean = marked.filter("NOT leaks").drop("leaks")
    rows = curate.tag_source(curate.stratified_split(clean), "synthetic")
    sources = {
        "pairs": fixtures.pairs(spark, sf_dir).select(*TRAIN_COLUMNS),
        "questions": fixtures.eval_set(spark, sf_dir).select(*EVAL_COLUMNS),
    }
    return curate.manifest(rows.filter("split = 'train'"), rows.filter("split = 'val'"), removed, sources)


@query(
    "c11_tag_source",
    """SELECT pair_id, db_id, coalesce(difficulty, 'unknown') AS difficulty, 'synthetic' AS source,
'sql_generation' AS task FROM f_pairs""",
    P,
)
def tag_source(spark, sf_dir):
    tagged = curate.tag_source(fixtures.pairs(spark, sf_dir), "synthetic")
    return tagged.select("pair_id", "db_id", "difficulty", "source", "task")


@query("c22_filter_databases", "SELECT question_id, db_id FROM f_eval WHERE db_id IN ('db_F', 'db_P')", ("f_eval",))
def filter_databases(spark, sf_dir):
    kept = curate.filter_databases(fixtures.eval_set(spark, sf_dir), ["db_F", "db_P"])
    return kept.select("question_id", "db_id")
