"""Views derived from the given tables, once as DataFrames and once as SQL.

They stand in for pair files, evaluation questions, prediction files, model
replies, result sets, call logs and query plans, and grow with the tables.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS pair_id",
        "concat('db_', o_orderstatus) AS db_id",
        "concat('What did customer ', CAST(o_custkey AS STRING), ' spend?') AS question",
        "concat(CASE WHEN o_orderkey % 4 = 0 THEN 'SELECT DISTINCT ' ELSE 'SELECT ' END, "
        "'T1.o_totalprice AS price FROM orders AS T1 INNER JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey "
        "WHERE T2.c_custkey = ', CAST(o_custkey AS STRING), "
        "CASE WHEN o_orderkey % 3 = 0 THEN ' ORDER BY T1.o_totalprice DESC LIMIT 5;' ELSE ';' END) AS sql",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'simple' WHEN '2-HIGH' THEN 'moderate' "
        "WHEN '3-MEDIUM' THEN 'challenging' END AS difficulty",
        "o_orderkey % 17 <> 0 AS parse_ok",
        "o_orderkey % 7 <> 0 AS exec_ok",
        "CAST(o_orderkey % 5 AS BIGINT) AS row_count",
    )


def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS question_id",
        "concat('db_', o_orderstatus) AS db_id",
        "concat('Spend of customer ', CAST(o_custkey AS STRING)) AS question",
        "'' AS evidence",
        "concat('select o_totalprice from orders join customer on o_custkey=c_custkey where c_custkey=', "
        "CAST(o_custkey AS STRING)) AS gold_sql",
        "CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        eval_set(spark, sf_dir)
        .withColumn("a", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .selectExpr(
            "question_id",
            "db_id",
            "difficulty",
            "concat('arm_', CAST(a AS STRING)) AS arm",
            "seed",
            "CASE WHEN (question_id + a) % 13 = 0 THEN 'ambiguous' WHEN (question_id + seed) % 11 = 0 THEN 'error' "
            "ELSE concat('SELECT ', CAST(question_id % (3 + a) AS STRING)) END AS predicted_sql",
            "CASE WHEN question_id % 9 = 0 THEN 'ambiguous' ELSE gold_sql END AS gold_sql",
            "(question_id * 7 + a * 31 + seed * 17) % 11 < 5 AS correct",
            "0.5e0 + (question_id % 8) / 16.0e0 AS t_gold",
            "0.25e0 + ((question_id + seed) % 4) / 4.0e0 AS t_pred",
        )
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).selectExpr(
        "pair_id AS reply_id",
        "CASE pair_id % 4 WHEN 0 THEN concat('To find it, use:\\n```sql\\n', sql, '\\n```\\nThis selects rows.') "
        "WHEN 1 THEN sql WHEN 2 THEN concat('/* note */ ', sql, ' -- end') ELSE 'I cannot answer this.' END AS reply",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    gold = orders.selectExpr(
        "CAST(o_custkey % 50 AS BIGINT) AS query_id", "'gold' AS side", "o_orderstatus AS c0", "o_totalprice AS c1"
    )
    pred = orders.filter("o_custkey % 50 <> 49").selectExpr(
        "CAST(o_custkey % 50 AS BIGINT) AS query_id",
        "'pred' AS side",
        "o_orderstatus AS c0",
        "CASE WHEN o_custkey % 50 < 20 AND o_orderkey % 9 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS c1",
    )
    return gold.unionByName(pred)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id AS call_id",
        "ts",
        "event_type AS arm",
        "50 + (event_id % 200) AS prompt_tokens",
        "5 + (user_id % 60) AS completion_tokens",
        "value AS latency_s",
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).selectExpr(
        "pair_id AS query_id",
        "concat('{\"Node Type\":\"', CASE pair_id % 3 WHEN 0 THEN 'Hash Join' WHEN 1 THEN 'Nested Loop' "
        "ELSE 'Merge Join' END, '\",\"Plans\":[{\"Node Type\":\"Seq Scan\",\"Relation Name\":\"orders\"},"
        "{\"Node Type\":\"Hash\",\"Plans\":[{\"Node Type\":\"', CASE pair_id % 2 WHEN 0 THEN 'Seq Scan' "
        "ELSE 'Index Scan' END, '\",\"Relation Name\":\"', CASE pair_id % 5 WHEN 0 THEN 'nation' ELSE 'customer' END, "
        "'\"}]}]}') AS plan_json",
    )


# Statements whose names depend on scopes, with the names they have, written by hand: tables, qualified
# columns and join keys, each in order. # stands for the row's order key.
STATEMENTS = (
    (
        "SELECT a.o_totalprice FROM orders a, customer b, nation AS n WHERE a.o_custkey = b.c_custkey AND b.c_nationkey = n.n_nationkey AND a.o_orderkey = #",
        "customer, nation, orders",
        "customer.c_custkey, customer.c_nationkey, nation.n_nationkey, orders.o_custkey, orders.o_orderkey, orders.o_totalprice",
        "customer.c_custkey = orders.o_custkey, customer.c_nationkey = nation.n_nationkey",
    ),
    (
        "SELECT t.o_totalprice FROM orders t WHERE t.o_orderkey IN (SELECT t.l_orderkey FROM lineitem t JOIN part p ON t.l_partkey = p.p_partkey) AND t.o_custkey = #",
        "lineitem, orders, part",
        "lineitem.l_orderkey, lineitem.l_partkey, orders.o_custkey, orders.o_orderkey, orders.o_totalprice, part.p_partkey",
        "lineitem.l_partkey = part.p_partkey",
    ),
    (
        "SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_tax > #)",
        "lineitem, orders",
        "lineitem.l_orderkey, lineitem.l_tax, orders.o_orderkey",
        "lineitem.l_orderkey = orders.o_orderkey",
    ),
    (
        "WITH big AS (SELECT o.o_custkey FROM orders o WHERE o.o_totalprice > #) SELECT big.o_custkey, c.c_name FROM big JOIN customer c ON big.o_custkey = c.c_custkey",
        "big, customer, orders",
        "big.o_custkey, customer.c_custkey, customer.c_name, orders.o_custkey, orders.o_totalprice",
        "big.o_custkey = customer.c_custkey",
    ),
    (
        "SELECT s.total, c.c_name FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) s JOIN customer c ON s.o_custkey = c.c_custkey WHERE c.c_custkey = #",
        "customer, orders",
        "customer.c_custkey, customer.c_name",
        "",
    ),
    (
        "SELECT c.c_name, x.o_orderkey FROM customer c, LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey) x WHERE c.c_custkey = #",
        "customer, orders",
        "customer.c_custkey, customer.c_name, orders.o_custkey, orders.o_orderkey",
        "customer.c_custkey = orders.o_custkey",
    ),
    (
        "SELECT count(*) FROM region r LEFT JOIN (nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey) ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey = #",
        "nation, region, supplier",
        "nation.n_nationkey, nation.n_regionkey, region.r_regionkey, supplier.s_nationkey",
        "nation.n_nationkey = supplier.s_nationkey, nation.n_regionkey = region.r_regionkey",
    ),
    (
        "SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = # UNION ALL SELECT o.l_orderkey FROM lineitem o, part p WHERE o.l_partkey = p.p_partkey",
        "lineitem, orders, part",
        "lineitem.l_orderkey, lineitem.l_partkey, orders.o_custkey, orders.o_orderkey, part.p_partkey",
        "lineitem.l_partkey = part.p_partkey",
    ),
    (
        "SELECT EXTRACT(YEAR FROM o.o_orderdate), TRIM(BOTH 'x' FROM c.c_name) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name IS DISTINCT FROM o.o_orderstatus AND o.o_orderkey = #",
        "customer, orders",
        "customer.c_custkey, customer.c_name, orders.o_custkey, orders.o_orderdate, orders.o_orderkey, orders.o_orderstatus",
        "customer.c_custkey = orders.o_custkey",
    ),
    (
        "SELECT g.n, o.o_orderkey FROM generate_series(1, 9) g(n), orders o WHERE o.o_orderkey = g.n AND o.o_custkey = #",
        "orders",
        "orders.o_custkey, orders.o_orderkey",
        "",
    ),
    (
        "SELECT \"o\".\"o_orderkey\" FROM \"orders\" \"o\" JOIN public.customer AS c ON \"o\".o_custkey = c.\"c_custkey\" WHERE o.o_orderkey = #",
        "customer, orders",
        "customer.c_custkey, orders.o_custkey, orders.o_orderkey",
        "customer.c_custkey = orders.o_custkey",
    ),
    (
        "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey + 1 = b.n_nationkey AND a.n_nationkey < #",
        "nation",
        "nation.n_name, nation.n_nationkey, nation.n_regionkey",
        "",
    ),
    (
        "SELECT orders.o_orderkey FROM orders JOIN lineitem USING (l_orderkey) WHERE orders.o_custkey = lineitem.l_suppkey - # OR orders.o_orderkey = lineitem.l_orderkey",
        "lineitem, orders",
        "lineitem.l_orderkey, lineitem.l_suppkey, orders.o_custkey, orders.o_orderkey",
        "lineitem.l_orderkey = orders.o_orderkey",
    ),
    (
        "SELECT (SELECT max(l.l_tax) FROM lineitem l WHERE l.l_orderkey = l2.l_orderkey) FROM lineitem l2, (SELECT s.s_suppkey FROM supplier s) l WHERE l.s_suppkey = l2.l_suppkey AND l2.l_partkey = #",
        "lineitem, supplier",
        "lineitem.l_orderkey, lineitem.l_partkey, lineitem.l_suppkey, lineitem.l_tax, supplier.s_suppkey",
        "",
    ),
    (
        "SELECT p.p_name /* FROM nowhere n */ FROM part p -- JOIN nothing x ON x.a = p.b\n JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE p.p_name = 'from part q' AND l.l_orderkey = # AND z.a = p.p_partkey",
        "lineitem, part",
        "lineitem.l_orderkey, lineitem.l_partkey, part.p_name, part.p_partkey",
        "lineitem.l_partkey = part.p_partkey",
    ),
    (
        "SELECT o.o_orderkey FROM orders AS o JOIN (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT o.n_nationkey FROM nation o JOIN region r ON o.n_regionkey = r.r_regionkey)) AS c ON o.o_custkey = c.c_custkey, supplier s WHERE s.s_suppkey = o.o_orderkey AND o.o_orderkey = #",
        "customer, nation, orders, region, supplier",
        "customer.c_custkey, customer.c_nationkey, nation.n_nationkey, nation.n_regionkey, orders.o_custkey, orders.o_orderkey, region.r_regionkey, supplier.s_suppkey",
        "nation.n_regionkey = region.r_regionkey, orders.o_orderkey = supplier.s_suppkey",
    ),
)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of ``STATEMENTS`` per order."""
    texts = F.array(*[F.lit(text) for text, *_ in STATEMENTS])
    shape = F.pmod("o_orderkey", F.lit(len(STATEMENTS))).cast("int")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("statement_id"),
        F.replace(F.get(texts, shape), F.lit("#"), F.col("o_orderkey").cast("string")).alias("sql"),
    )


def _expected_statements() -> str:
    rows = ", ".join(f"({k}, '{tables}', '{columns}', '{keys}')" for k, (_, tables, columns, keys) in enumerate(STATEMENTS))
    return (
        "SELECT o_orderkey AS statement_id, expected_tables, expected_columns, expected_keys FROM orders "
        f"JOIN (VALUES {rows}) v(shape, expected_tables, expected_columns, expected_keys) "
        f"ON o_orderkey % {len(STATEMENTS)} = shape"
    )


# The same views in DuckDB SQL, each with the views it needs.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f_pairs": (
        (),
        "SELECT o_orderkey AS pair_id, concat('db_', o_orderstatus) AS db_id, "
        "concat('What did customer ', CAST(o_custkey AS VARCHAR), ' spend?') AS question, "
        "concat(CASE WHEN o_orderkey % 4 = 0 THEN 'SELECT DISTINCT ' ELSE 'SELECT ' END, "
        "'T1.o_totalprice AS price FROM orders AS T1 INNER JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey "
        "WHERE T2.c_custkey = ', CAST(o_custkey AS VARCHAR), "
        "CASE WHEN o_orderkey % 3 = 0 THEN ' ORDER BY T1.o_totalprice DESC LIMIT 5;' ELSE ';' END) AS sql, "
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'simple' WHEN '2-HIGH' THEN 'moderate' "
        "WHEN '3-MEDIUM' THEN 'challenging' END AS difficulty, "
        "o_orderkey % 17 <> 0 AS parse_ok, o_orderkey % 7 <> 0 AS exec_ok, "
        "CAST(o_orderkey % 5 AS BIGINT) AS row_count FROM orders",
    ),
    "f_statements": ((), _expected_statements()),
    "f_eval": (
        (),
        "SELECT o_orderkey AS question_id, concat('db_', o_orderstatus) AS db_id, "
        "concat('Spend of customer ', CAST(o_custkey AS VARCHAR)) AS question, '' AS evidence, "
        "concat('select o_totalprice from orders join customer on o_custkey=c_custkey where c_custkey=', "
        "CAST(o_custkey AS VARCHAR)) AS gold_sql, "
        "CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty "
        "FROM orders",
    ),
    "f_scores": (
        ("f_eval",),
        "SELECT e.question_id, e.db_id, e.difficulty, concat('arm_', CAST(a.arm AS VARCHAR)) AS arm, s.seed, "
        "CASE WHEN (e.question_id + a.arm) % 13 = 0 THEN 'ambiguous' "
        "WHEN (e.question_id + s.seed) % 11 = 0 THEN 'error' "
        "ELSE concat('SELECT ', CAST(e.question_id % (3 + a.arm) AS VARCHAR)) END AS predicted_sql, "
        "CASE WHEN e.question_id % 9 = 0 THEN 'ambiguous' ELSE e.gold_sql END AS gold_sql, "
        "(e.question_id * 7 + a.arm * 31 + s.seed * 17) % 11 < 5 AS correct, "
        "0.5e0 + (e.question_id % 8) / 16.0e0 AS t_gold, "
        "0.25e0 + ((e.question_id + s.seed) % 4) / 4.0e0 AS t_pred "
        "FROM f_eval e, (VALUES (0), (1), (2)) a(arm), (VALUES (0), (1), (2)) s(seed)",
    ),
    "f_replies": (
        ("f_pairs",),
        "SELECT pair_id AS reply_id, CASE pair_id % 4 "
        "WHEN 0 THEN concat(E'To find it, use:\\n```sql\\n', sql, E'\\n```\\nThis selects rows.') "
        "WHEN 1 THEN sql WHEN 2 THEN concat('/* note */ ', sql, ' -- end') "
        "ELSE 'I cannot answer this.' END AS reply FROM f_pairs",
    ),
    "f_results": (
        (),
        "SELECT CAST(o_custkey % 50 AS BIGINT) AS query_id, 'gold' AS side, o_orderstatus AS c0, o_totalprice AS c1 "
        "FROM orders UNION ALL SELECT CAST(o_custkey % 50 AS BIGINT), 'pred', o_orderstatus, "
        "CASE WHEN o_custkey % 50 < 20 AND o_orderkey % 9 = 0 THEN o_totalprice + 1 ELSE o_totalprice END "
        "FROM orders WHERE o_custkey % 50 <> 49",
    ),
    "f_calls": (
        (),
        "SELECT event_id AS call_id, ts, event_type AS arm, 50 + (event_id % 200) AS prompt_tokens, "
        "5 + (user_id % 60) AS completion_tokens, value AS latency_s FROM events",
    ),
    "f_plans": (
        ("f_pairs",),
        "SELECT pair_id AS query_id, concat('{\"Node Type\":\"', CASE pair_id % 3 WHEN 0 THEN 'Hash Join' "
        "WHEN 1 THEN 'Nested Loop' ELSE 'Merge Join' END, "
        "'\",\"Plans\":[{\"Node Type\":\"Seq Scan\",\"Relation Name\":\"orders\"},"
        "{\"Node Type\":\"Hash\",\"Plans\":[{\"Node Type\":\"', CASE pair_id % 2 WHEN 0 THEN 'Seq Scan' "
        "ELSE 'Index Scan' END, '\",\"Relation Name\":\"', CASE pair_id % 5 WHEN 0 THEN 'nation' ELSE 'customer' END, "
        "'\"}]}]}') AS plan_json FROM f_pairs",
    ),
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Put the derived views in front of ``sql`` as common table expressions."""
    if not views:
        return sql
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in SQL_VIEWS[name][0]:
            add(parent)
        if name not in needed:
            needed.append(name)

    for view in views:
        add(view)
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name][1]})" for name in needed)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        if recursive:
            rest = rest[9:].lstrip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
