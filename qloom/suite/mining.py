"""Plans and statements of the workload."""

from __future__ import annotations

from pyspark.sql import functions as F

from qloom.functions import text
from qloom.operators import profile, workload
from qloom.suite import fixtures
from qloom.suite.profiling import COLUMNS, RELATIONAL, tables
from qloom.suite.registry import query

PL, P, S = ("f_plans",), ("f_pairs",), ("f_statements",)

NODES = """
RECURSIVE walk AS (
  SELECT query_id, '0' AS path, 0 AS depth, plan_json::JSON AS node FROM f_plans
  UNION ALL
  SELECT query_id, path || '.' || i, depth + 1, json_extract(node, '$.Plans[' || i || ']')
  FROM (SELECT *, unnest(range(0, CAST(coalesce(json_array_length(node, '$.Plans'), 0) AS BIGINT))) AS i FROM walk)),
nodes AS (SELECT query_id, path, depth, json_extract_string(node, '$."Node Type"') AS node_type,
            json_extract_string(node, '$."Relation Name"') AS relation,
            CAST(coalesce(json_array_length(node, '$.Plans'), 0) AS INTEGER) AS children FROM walk)"""


def nodes(spark, sf_dir):
    return workload.flatten_plans(fixtures.plans(spark, sf_dir))


@query("w1_flatten_plans", f"WITH {NODES} SELECT * FROM nodes", PL)
def flatten_plans(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(
    "w2_table_frequency",
    f"WITH {NODES} SELECT relation, count(*) AS nodes FROM nodes WHERE relation IS NOT NULL GROUP BY relation",
    PL,
)
def table_frequency(spark, sf_dir):
    return workload.table_frequency(nodes(spark, sf_dir))


@query(
    "w3_scan_methods",
    f"""WITH {NODES} SELECT relation || ':' || node_type AS scan, count(*) AS nodes FROM nodes
WHERE relation IS NOT NULL GROUP BY 1""",
    PL,
)
def scan_methods(spark, sf_dir):
    return workload.scan_methods(nodes(spark, sf_dir))


JOINS = "node_type IN ('Nested Loop', 'Hash Join', 'Merge Join') AND children >= 2"


@query(
    "w4_join_operators",
    f"WITH {NODES} SELECT node_type, count(*) AS nodes FROM nodes WHERE {JOINS} GROUP BY node_type",
    PL,
)
def join_operators(spark, sf_dir):
    return workload.join_operators(nodes(spark, sf_dir))


@query(
    "w5_join_paths",
    f"""WITH {NODES},
side AS (SELECT DISTINCT j.query_id, j.path, l.relation, starts_with(l.path, j.path || '.0') AS is_left
         FROM nodes j JOIN nodes l ON l.query_id = j.query_id AND l.relation IS NOT NULL AND
           (l.path = j.path || '.0' OR starts_with(l.path, j.path || '.0.') OR l.path = j.path || '.1'
            OR starts_with(l.path, j.path || '.1.'))
         WHERE j.node_type IN ('Nested Loop', 'Hash Join', 'Merge Join') AND j.children >= 2)
SELECT least(a.relation, b.relation) || '|' || greatest(a.relation, b.relation) AS path, count(*) AS nodes
FROM side a JOIN side b ON a.query_id = b.query_id AND a.path = b.path AND a.is_left AND NOT b.is_left
 AND a.relation <> b.relation GROUP BY 1""",
    PL,
)
def join_paths(spark, sf_dir):
    return workload.join_paths(fixtures.plans(spark, sf_dir))


SOLD = "replace(sql, 'T2.c_custkey =', 'T1.o_orderkey = T3.l_orderkey AND T2.c_custkey =')"


@query(
    "w6_static_join_keys",
    r"""WITH e AS (SELECT unnest(list_zip(regexp_extract_all(sql, '(?i)\b([a-z_]\w*)\.([a-z_]\w*)\s*=\s*([a-z_]\w*)\.([a-z_]\w*)', 1),
    regexp_extract_all(sql, '(?i)\b([a-z_]\w*)\.([a-z_]\w*)\s*=\s*([a-z_]\w*)\.([a-z_]\w*)', 2),
    regexp_extract_all(sql, '(?i)\b([a-z_]\w*)\.([a-z_]\w*)\s*=\s*([a-z_]\w*)\.([a-z_]\w*)', 3),
    regexp_extract_all(sql, '(?i)\b([a-z_]\w*)\.([a-z_]\w*)\s*=\s*([a-z_]\w*)\.([a-z_]\w*)', 4))) AS z, pair_id
  FROM (SELECT pair_id, """
    + SOLD
    + r""" AS sql FROM f_pairs)),
t AS (SELECT CASE z[1] WHEN 'T1' THEN 'orders' WHEN 'T2' THEN 'customer' END AS lt, z[2] AS lc,
             CASE z[3] WHEN 'T1' THEN 'orders' WHEN 'T2' THEN 'customer' END AS rt, z[4] AS rc FROM e)
SELECT least(lt || '.' || lc, rt || '.' || rc) || ' = ' || greatest(lt || '.' || lc, rt || '.' || rc) AS join_key, count(*) AS n
FROM t WHERE lt IS NOT NULL AND rt IS NOT NULL AND lt <> rt GROUP BY 1""",
    P,
)
def static_join_keys(spark, sf_dir):
    # The added equality names an alias no table has, so it must be left out.
    return workload.static_join_keys(fixtures.pairs(spark, sf_dir).withColumn("sql", F.expr(SOLD)))


NAMES = r"regexp_extract_all(sql, '(?i)\b(?:from|join)\s+([a-z_]\w*)', 1)"


@query(
    "w7_accessed_tables",
    f"SELECT pair_id, array_to_string(list_sort(list_distinct(list_transform({NAMES}, lambda x: lower(x)))), ',') AS tables FROM f_pairs",
    P,
)
def accessed_tables(spark, sf_dir):
    found = workload.accessed_tables(fixtures.pairs(spark, sf_dir))
    return found.select("pair_id", F.array_join("tables", ",").alias("tables"))


KNOWN = "[" + ", ".join(f"'{c}'" for t in RELATIONAL for c, _ in COLUMNS[t]) + "]"
KNOWN_NAMES = "[" + ", ".join(f"'{t}.{c}'" for t in RELATIONAL for c, _ in COLUMNS[t]) + "]"


def schema(spark, sf_dir):
    """Every database of the pairs has the relational tables."""
    inventory = profile.schema_inventory(spark, tables(spark, sf_dir))
    names = F.explode(F.array(*[F.lit(f"db_{s}") for s in "FOP"]))
    return workload.inventory_arrays(inventory.withColumn("db_id", names))


@query(
    "w8_referenced_columns",
    rf"""SELECT pair_id, array_to_string(list_sort(list_distinct({NAMES})), ',') AS tables,
array_to_string(list_sort(list_intersect({KNOWN}, regexp_extract_all(sql, '(?i)\b[a-z_]\w*\b'))), ',') AS columns FROM f_pairs""",
    P,
)
def referenced_columns(spark, sf_dir):
    found = workload.referenced_columns(fixtures.pairs(spark, sf_dir), schema(spark, sf_dir))
    return found.select("pair_id", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"))


WRONG = "CASE WHEN pair_id % 6 = 0 THEN replace(sql, 'o_totalprice', 'o_price') ELSE sql END"


@query(
    "w9_schema_validity",
    rf"""WITH t AS (SELECT pair_id % 3 AS arm, list_transform(regexp_extract_all({WRONG}, '(?i)\bT[12]\.[a-z_]\w*'),
   lambda x: CASE WHEN starts_with(x, 'T1.') THEN 'orders.' || substr(x, 4) ELSE 'customer.' || substr(x, 4) END) AS refs FROM f_pairs),
j AS (SELECT arm, len(list_filter(refs, lambda r: NOT list_contains({KNOWN_NAMES}, r))) > 0 AS unknown FROM t)
SELECT arm, count(*) AS statements, count(*) FILTER (unknown) AS invalid,
       round(100.0 * count(*) FILTER (unknown) / count(*), 6) AS invalid_share FROM j GROUP BY arm""",
    P,
)
def schema_validity(spark, sf_dir):
    predictions = fixtures.pairs(spark, sf_dir).withColumns({"arm": F.col("pair_id") % 3, "sql": F.expr(WRONG)})
    return workload.schema_validity(predictions, schema(spark, sf_dir))


# Names of statements with scopes, each list as one text.
NAMED = "SELECT statement_id, {} FROM f_statements"


@query("w6_scoped_join_keys", "SELECT unnest(string_split(expected_keys, ', ')) AS join_key, count(*) AS n FROM f_statements WHERE expected_keys <> '' GROUP BY 1", S)
def scoped_join_keys(spark, sf_dir):
    return workload.static_join_keys(fixtures.statements(spark, sf_dir))


@query("w7_scoped_tables", NAMED.format("expected_tables AS tables"), S)
def scoped_tables(spark, sf_dir):
    found = workload.accessed_tables(fixtures.statements(spark, sf_dir))
    return found.select("statement_id", F.array_join("tables", ", ").alias("tables"))


@query("w9_scoped_columns", NAMED.format("expected_columns AS columns"), S)
def scoped_columns(spark, sf_dir):
    found = workload.with_names(fixtures.statements(spark, sf_dir))
    return found.select("statement_id", F.array_join(F.array_sort("names.columns"), ", ").alias("columns"))


@query(
    "w10_access_ranking",
    f"""WITH {NODES},
c AS (SELECT relation, nullif(count(*) FILTER (node_type LIKE 'Seq%'), 0) AS seq_scan,
        nullif(count(*) FILTER (node_type LIKE 'Index%'), 0) AS idx_scan FROM nodes WHERE relation IS NOT NULL GROUP BY relation)
SELECT *, coalesce(seq_scan, 0) + coalesce(idx_scan, 0) AS scans FROM c""",
    PL,
)
def access_ranking(spark, sf_dir):
    return workload.access_ranking(workload.scan_counters(nodes(spark, sf_dir)))


@query(
    "w11_corpus_summary",
    """SELECT db_id, count(*) AS queries, count(*) FILTER (parse_ok AND exec_ok) AS planned,
count(*) FILTER (NOT (parse_ok AND exec_ok)) AS failed FROM f_pairs GROUP BY db_id""",
    P,
)
def corpus_summary(spark, sf_dir):
    return workload.corpus_summary(fixtures.pairs(spark, sf_dir), F.col("parse_ok") & F.col("exec_ok"))


@query(
    "w11_first_failures",
    """WITH r AS (SELECT db_id, pair_id, row_number() OVER (PARTITION BY db_id ORDER BY pair_id) AS rn
  FROM f_pairs WHERE NOT (parse_ok AND exec_ok)) SELECT * FROM r WHERE rn <= 20""",
    P,
)
def first_failures(spark, sf_dir):
    failures = workload.first_failures(
        fixtures.pairs(spark, sf_dir), F.col("parse_ok") & F.col("exec_ok"), [F.col("pair_id")]
    )
    return failures.select("db_id", "pair_id", "rn")
