"""Profiles of the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from qloom.operators import profile, schema_text
from qloom.plans import local_frame
from qloom.suite import fixtures
from qloom.suite.registry import query, table

# Columns of the relational tables, for writing the SQL side.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
COLUMNS = {name: [c.split() for c in ddl.split(", ")] for name, ddl in SCHEMAS.items()}
RELATIONAL = [name for name in SCHEMAS if name != "documents"]


def tables(spark, sf_dir, names=RELATIONAL):
    return {name: table(spark, sf_dir, name) for name in names}


def union(parts):
    return "\nUNION ALL ".join(parts)


@query(
    "p1_schema_inventory",
    union(
        f"""SELECT '{t}' AS "table", CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{kind}' AS type,
        true AS nullable, count(*) - count({c}) AS nulls FROM {t}"""
        for t in SCHEMAS
        for i, (c, kind) in enumerate(COLUMNS[t], start=1)
    ),
)
def schema_inventory(spark, sf_dir):
    opened = tables(spark, sf_dir, list(SCHEMAS))
    found = profile.union_all([profile.null_fraction(name, df, keep_zero=True) for name, df in opened.items()])
    inventory = profile.schema_inventory(spark, opened)
    return inventory.join(found.drop("null_frac"), ["table", "column"])


@query("p2_row_counts", union(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}""" for t in SCHEMAS))
def row_counts(spark, sf_dir):
    return profile.row_counts(tables(spark, sf_dir, list(SCHEMAS)))


def with_gaps(spark, sf_dir):
    """Orders with NULLs where the given data has none."""
    return table(spark, sf_dir, "orders").withColumns(
        {
            "o_orderpriority": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")),
            "o_totalprice": F.when(F.col("o_orderkey") % 4001 != 0, F.col("o_totalprice")),
        }
    )


GAPS = """g AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 4001 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders)"""


@query(
    "p3_null_fraction",
    f"WITH {GAPS}, s AS ("
    + union(
        f"""SELECT 'orders' AS "table", '{c}' AS "column", count(*) - count({c}) AS nulls,
        round((count(*) - count({c})) / count(*), 3) AS null_frac FROM g"""
        for c, _ in COLUMNS["orders"]
    )
    + ") SELECT * FROM s WHERE nulls > 0",
)
def null_fraction(spark, sf_dir):
    return profile.null_fraction("orders", with_gaps(spark, sf_dir))


def signed(t, c):
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", count(DISTINCT {c}) AS distinct_values,
    round(CASE WHEN count(DISTINCT {c}) / count(*) > 0.1 THEN -count(DISTINCT {c}) / count(*)
          ELSE CAST(count(DISTINCT {c}) AS DOUBLE) END, 6) AS n_distinct FROM {t}"""


@query("p4_n_distinct", union(signed(t, c) for t in ("orders", "lineitem") for c, _ in COLUMNS[t]))
def n_distinct(spark, sf_dir):
    return profile.union_all(
        [profile.n_distinct(t, table(spark, sf_dir, t)) for t in ("orders", "lineitem")]
    )


COMMON = {"orders": ["o_custkey", "o_orderstatus", "o_orderpriority"], "customer": ["c_nationkey", "c_mktsegment"]}


@query(
    "p5_most_common_values",
    "WITH f AS ("
    + union(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
        (SELECT count(*) FROM {t}) AS total FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"""
        for t, cs in COMMON.items()
        for c in cs
    )
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value) AS rank FROM f)
SELECT "table", "column", rank, value, n, round(n / total, 6) AS freq FROM r WHERE rank <= 10""",
)
def most_common_values(spark, sf_dir):
    return profile.union_all(
        [profile.most_common_values(t, table(spark, sf_dir, t), 10, cs) for t, cs in COMMON.items()]
    )


def bounds(t, c, b):
    return f"""WITH r AS (SELECT {c} AS value, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n
      FROM {t} WHERE {c} IS NOT NULL)
SELECT '{t}' AS "table", '{c}' AS "column", CAST(i AS BIGINT) AS bound, value
FROM r JOIN range(0, {b + 1}) q(i) ON rn = greatest(1, ceil(n * i / {b}))"""


@query("p6_histogram_bounds", bounds("lineitem", "l_quantity", 10))
def histogram_bounds(spark, sf_dir):
    return profile.histogram_bounds("lineitem", table(spark, sf_dir, "lineitem"), "l_quantity", 10)


@query("p6_histogram_bounds_text", bounds("customer", "c_name", 20))
def histogram_bounds_text(spark, sf_dir):
    return profile.histogram_bounds("customer", table(spark, sf_dir, "customer"), "c_name", 20)


@query("p6_histogram_bounds_price", bounds("lineitem", "l_extendedprice", 100))
def histogram_bounds_price(spark, sf_dir):
    return profile.histogram_bounds("lineitem", table(spark, sf_dir, "lineitem"), "l_extendedprice", 100)


DOMAIN = {"customer": ["c_mktsegment", "c_nationkey", "c_name"], "part": ["p_type", "p_brand", "p_size", "p_name"]}


def domain_sql(t, c):
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) OVER () AS n, v,
    row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL)"""


@query(
    "p7_value_domain",
    "WITH d AS ("
    + union(domain_sql(t, c) for t, cs in DOMAIN.items() for c in cs)
    + """) SELECT "table", "column", CASE WHEN max(n) <= 15 THEN 'all_values' ELSE 'sample_values' END AS kind,
string_agg(CASE WHEN length(v) > 120 THEN substring(v, 1, 120) || '...' ELSE v END, '|' ORDER BY rn)
  FILTER (n <= 15 OR rn <= 5) AS values FROM d GROUP BY ALL""",
)
def value_domain(spark, sf_dir):
    found = profile.union_all([profile.value_domain(t, table(spark, sf_dir, t), cs) for t, cs in DOMAIN.items()])
    return found.withColumn("values", F.array_join("values", "|"))


@query(
    "p8_low_cardinality_hints",
    "WITH d AS ("
    + union(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' = 'string' AS quoted, v FROM
        (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL)"""
        for t in ("customer", "lineitem")
        for c, kind in COLUMNS[t]
    )
    + """) SELECT "table", "column", 'All values of "' || "table" || '.' || "column" || '": [' ||
string_agg(CASE WHEN quoted THEN '''' || v || '''' ELSE v END, ', ' ORDER BY v) || ']' AS hint
FROM d GROUP BY "table", "column" HAVING count(*) BETWEEN 1 AND 10""",
)
def low_cardinality_hints(spark, sf_dir):
    return profile.union_all(
        [profile.low_cardinality_hints(t, table(spark, sf_dir, t)) for t in ("customer", "lineitem")]
    )


SAMPLED = {"nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}


@query(
    "p9_sample_rows",
    union(
        f"""SELECT * FROM (SELECT '{t}' AS "table", CAST(to_json({{{', '.join(f"'{c}': {c}" for c, _ in COLUMNS[t])}}}) AS VARCHAR) AS row
        FROM (SELECT * FROM {t} ORDER BY {k} LIMIT {3 if t == 'part' else 5}))"""
        for t, k in SAMPLED.items()
    ),
)
def sample_rows(spark, sf_dir):
    return profile.sample_rows(
        tables(spark, sf_dir, list(SAMPLED)), {t: [k] for t, k in SAMPLED.items()}, 5, {"part": 3}
    )


CUT = "CASE WHEN length({0}) > 120 THEN substring({0}, 1, 120) || '...' ELSE {0} END"


@query(
    "p10_truncate_text",
    f"""SELECT 'documents' AS "table", doc_id AS id, {CUT.format('text')} AS shown FROM documents
UNION ALL SELECT 'pages', page_id, {CUT.format('html')} FROM pages""",
)
def truncate_text(spark, sf_dir):
    def cut(name, key, column):
        shown = profile.text.truncate_text(F.col(column)).alias("shown")
        return table(spark, sf_dir, name).select(F.lit(name).alias("table"), F.col(key).alias("id"), shown)

    return cut("documents", "doc_id", "text").unionByName(cut("pages", "page_id", "html"))


KEYS = union(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", {i} AS ordinal FROM {t} HAVING count(*) = count(DISTINCT {c})"""
    for t in RELATIONAL
    for i, (c, _) in enumerate(COLUMNS[t], start=1)
)
INVENTORY = union(
    f"""SELECT '{t}' AS "table", {o} AS t_order, '{c}' AS "column", {i} AS ordinal"""
    for o, t in enumerate(RELATIONAL)
    for i, (c, _) in enumerate(COLUMNS[t], start=1)
)


def first_keys(spark, sf_dir):
    """(table, order, column, ordinal): the leftmost single-column key of each table."""
    opened = tables(spark, sf_dir)
    inventory = profile.schema_inventory(spark, opened)
    order = local_frame(spark, enumerate(opened), "order int, table string")
    found = profile.discover_keys(opened).join(inventory, ["table", "column"]).join(order, "table")
    return found.groupBy("table", "order").agg(F.min_by("column", "ordinal").alias("column"))


@query(
    "p11_implied_edges",
    f"""WITH k AS ({KEYS}), inv AS ({INVENTORY}),
pk AS (SELECT "table", arg_min("column", ordinal) AS c FROM k GROUP BY 1),
own AS (SELECT regexp_replace(c, '^[a-z]+_', '') AS name, arg_max(pk."table", t_order) AS owner
        FROM pk JOIN (SELECT DISTINCT "table", t_order FROM inv) o USING ("table") GROUP BY 1)
SELECT "table", name AS "column", owner AS to_table
FROM (SELECT "table", regexp_replace("column", '^[a-z]+_', '') AS name FROM inv) JOIN own USING (name)
WHERE owner <> "table" AND NOT ("table" = 'orders' AND name = 'custkey')""",
)
def implied_edges(spark, sf_dir):
    # Column names carry a table prefix here; without it they name the key they refer to.
    bare = F.regexp_replace("column", "^[a-z]+_", "")
    inventory = profile.schema_inventory(spark, tables(spark, sf_dir)).withColumn("column", bare)
    keys = first_keys(spark, sf_dir).select("table", "order", F.array(bare).alias("key"))
    declared = local_frame(spark, [("orders", ["custkey"])], "table string, columns array<string>")
    return profile.implied_edges(inventory, keys, declared)


EDGES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


@query("p12_discover_keys", f"""SELECT "table", "column" FROM ({KEYS})""")
def discover_keys(spark, sf_dir):
    return profile.discover_keys(tables(spark, sf_dir))


@query(
    "p12_discover_edges",
    union(
        f"""SELECT '{a}' AS "table", '{b}' AS "column", '{c}' AS to_table, '{d}' AS to_column,
        (SELECT count(DISTINCT {b}) FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c})) AS missing"""
        for a, b, c, d in EDGES
    ),
)
def discover_edges(spark, sf_dir):
    opened = tables(spark, sf_dir)
    keys = list(dict.fromkeys((c, d) for _, _, c, d in EDGES))
    return profile.discover_edges(opened, profile.same_suffix_pairs(opened, keys))


# Tables whose keys may have several columns.
KEYED = {**{t: [c for c, _ in COLUMNS[t]] for t in RELATIONAL}, "conversations": ["conv_id", "turn", "role", "text"], "labels": ["doc_id", "quality", "toxic"]}


def _key_rows():
    """All sets of one or two columns, as rows (table, columns, part of it, whether it is a key)."""
    for t, columns in KEYED.items():
        sets = [s for k in (1, 2) for s in combinations(columns, k)]
        tests = ", ".join(
            f"count(*) > 0 AND count(*) = count(DISTINCT ({', '.join(s)}, 0)) AND count(*) = count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in s)})"
            for s in sets
        )
        names = ", ".join("'" + ", ".join(s) + "'" for s in sets)
        yield f"""SELECT '{t}' AS "table", unnest([{names}]) AS columns, unnest([{tests}]) AS is_key FROM {t}"""


@query(
    "p12_composite_keys",
    f"""WITH k AS (SELECT "table", columns, string_split(columns, ', ') AS parts FROM ({union(_key_rows())}) WHERE is_key)
SELECT "table", columns FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o."table" = k."table"
AND len(o.parts) < len(k.parts) AND len(list_intersect(o.parts, k.parts)) = len(o.parts))""",
)
def composite_keys(spark, sf_dir):
    opened = tables(spark, sf_dir, list(KEYED))
    return profile.discover_composite_keys(opened)


RETURNED = "SELECT l_orderkey AS r_orderkey, l_linenumber + CASE WHEN l_quantity > 49 THEN 7 ELSE 0 END AS r_linenumber FROM lineitem WHERE l_returnflag = 'R'"


@query(
    "p12_composite_edges",
    f"""SELECT 'returned' AS "table", 'r_orderkey, r_linenumber' AS "column", 'lineitem' AS to_table,
'l_orderkey, l_linenumber' AS to_column, count(*) AS missing FROM
(SELECT DISTINCT * FROM ({RETURNED}) r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r_orderkey AND l_linenumber = r_linenumber))
UNION ALL SELECT 'lineitem', 'l_orderkey, l_linenumber', 'returned', 'r_orderkey, r_linenumber', count(*) FROM
(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM ({RETURNED}) r WHERE l_orderkey = r_orderkey AND l_linenumber = r_linenumber))""",
)
def composite_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    moved = F.col("l_linenumber") + F.when(F.col("l_quantity") > 49, 7).otherwise(0)
    returned = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("r_orderkey"), moved.alias("r_linenumber"))
    child, parent = ("returned", ("r_orderkey", "r_linenumber")), ("lineitem", ("l_orderkey", "l_linenumber"))
    return profile.discover_edges({"lineitem": lines, "returned": returned}, [(child, parent), (parent, child)])


def column_rows(spark, sf_dir, names, with_examples):
    """Schema rows in the shape the renderers take; keys are the first columns."""
    opened = tables(spark, sf_dir, names)
    order = local_frame(spark, enumerate(names), "table_order int, table string")
    rows = profile.schema_inventory(spark, opened).join(order, "table")
    rows = rows.withColumns(
        {
            "is_key": (F.col("ordinal") == 1) & (F.col("table") != "lineitem"),
            "comment": F.lit(None).cast("string"),
            "is_text": F.col("type") == "string",
        }
    )
    if not with_examples:
        return rows
    domains = profile.union_all([profile.value_domain(t, df) for t, df in opened.items()])
    return rows.join(domains.select("table", "column", F.col("values").alias("examples")), ["table", "column"], "left")


RENDERED = ["region", "nation", "customer", "supplier", "part", "orders"]


def edge_rows(spark, names, implied=False):
    rows = [(i, *e, implied) for i, e in enumerate(EDGES) if e[0] in names]
    return local_frame(
        spark, rows, "position int, table string, column string, to_table string, to_column string, implied boolean"
    )


def mschema_line(t, o, i, c, kind):
    key = ", Primary Key" if i == 1 else ""
    quoted = "'''' || v || ''''" if kind == "string" else "v"
    return f"""SELECT {o} AS t_order, '{t}' AS t, {i} AS ordinal, '({c}:{kind}{key}. Examples: [' ||
    string_agg({quoted}, ', ' ORDER BY v) || ']),' AS line FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} ORDER BY v LIMIT 3)"""


@query(
    "p13_render_mschema",
    "WITH l AS ("
    + union(
        mschema_line(t, o, i, c, kind)
        for o, t in enumerate(RENDERED)
        for i, (c, kind) in enumerate(COLUMNS[t], start=1)
    )
    + "), b AS (SELECT t_order, '# Table: ' || t || E'\\n[\\n' || string_agg(line, E'\\n' ORDER BY ordinal) || E'\\n]' AS block "
    "FROM l GROUP BY t_order, t) SELECT 'tpch' AS db_id, E'【DB_ID】 tpch\\n【Schema】\\n' || "
    "string_agg(block, E'\\n' ORDER BY t_order) || E'\\n【Foreign keys】\\n"
    + "\\n".join(f"{a}.{b} = {c}.{d}" for a, b, c, d in EDGES if a in RENDERED)
    + "\\n' AS text FROM b",
)
def render_mschema(spark, sf_dir):
    return schema_text.render_mschema(
        column_rows(spark, sf_dir, RENDERED, True), edge_rows(spark, RENDERED), "tpch"
    )


COMPACT = "\\n".join(f"{t}({', '.join(' '.join(c) for c in COLUMNS[t])})" for t in RELATIONAL)
# Edges that hold in the data are listed; a child value without a parent removes the line.
HELD = "(" + union(
    f"""SELECT {i} AS position, '  {a}.{b} -> {c}.{d}  (same column name)' AS line
    WHERE NOT EXISTS (SELECT 1 FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c}))"""
    for i, (a, b, c, d) in enumerate(EDGES)
) + ")"


def held_edges(spark, sf_dir):
    missing = discover_edges(spark, sf_dir).filter("missing = 0")
    keys = ["table", "column", "to_table", "to_column"]
    return edge_rows(spark, RELATIONAL, implied=True).join(missing.select(*keys), keys)


@query(
    "p14_compact_schema",
    f"""SELECT 'tpch' AS db_id, E'{COMPACT}\\n\\nJoins between tables:\\n' || string_agg(line, E'\\n' ORDER BY position) AS text,
CAST({len(RELATIONAL)} AS BIGINT) AS tables, count(*) AS edges FROM {HELD} h""",
)
def compact_schema(spark, sf_dir):
    rows = column_rows(spark, sf_dir, RELATIONAL, False)
    return schema_text.compact_schema(rows, "tpch", held_edges(spark, sf_dir))


@query(
    "p15_profile_size",
    f"""WITH s AS (SELECT 'tpch' AS db_id, E'{COMPACT}\\n\\nJoins between tables:\\n' ||
  string_agg(line, E'\\n' ORDER BY position) AS text, count(*) AS edges FROM {HELD} h)
SELECT db_id, CAST({len(RELATIONAL)} AS BIGINT) AS tables, edges,
       CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS BIGINT) AS tokens FROM s""",
)
def profile_size(spark, sf_dir):
    return schema_text.profile_size(compact_schema(spark, sf_dir))


@query(
    "p16_profile_coverage",
    """WITH c AS (SELECT db_id, CASE WHEN NOT parse_ok THEN 'does not parse' WHEN NOT exec_ok THEN 'fails to run' END AS reason,
  count(*) AS queries FROM f_pairs GROUP BY ALL)
SELECT db_id, reason, queries, round(100.0 * queries / sum(queries) OVER (PARTITION BY db_id), 4) AS share FROM c""",
    ("f_pairs",),
)
def profile_coverage(spark, sf_dir):
    ran = F.col("parse_ok") & F.col("exec_ok")
    reason = F.when(~F.col("parse_ok"), "does not parse").otherwise("fails to run")
    return schema_text.profile_coverage(fixtures.pairs(spark, sf_dir), ran, reason)


@query("p17_profile_one_pass")
def profile_one_pass(spark, sf_dir):
    """Sketch profile of the two largest tables; approximate, so without SQL."""
    found = profile.union_all([profile.profile_columns(t, table(spark, sf_dir, t)) for t in ("orders", "lineitem")])
    return found.withColumns({c: F.array_join(c, "|") for c in ("most_common", "bounds")})
