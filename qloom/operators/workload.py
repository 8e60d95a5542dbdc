"""What a workload touches: plan trees, join graph, tables and columns of statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.functions import text
from qloom.plans import lookup_join, top_per_group

JOIN_NODES = ("Nested Loop", "Hash Join", "Merge Join")  # fixed values

_NODE = "struct<`Node Type`: string, `Relation Name`: string, Plans: array<string>>"


def plan_nodes(plan_json: Column | str) -> Column:
    """array<struct<path, depth, node_type, relation, children>> of one plan tree.

    The tree is unfolded level by level inside its own row: no shuffle, no
    recursion across jobs. The text names ``Plans`` at least once per level, so
    its count is a depth every plan fits in.
    """
    column = plan_json if isinstance(plan_json, str) else "plan_json"
    return F.expr(
        f"""
        aggregate(
          sequence(1, regexp_count(`{column}`, '"Plans"') + 1),
          named_struct(
            'done', CAST(array() AS array<struct<path: string, depth: int, node_type: string, relation: string, children: int>>),
            'open', array(named_struct('path', '0', 'node', from_json(`{column}`, '{_NODE}')))),
          (state, level) -> named_struct(
            'done', concat(state.done, transform(state.open, o -> named_struct(
               'path', o.path, 'depth', level - 1, 'node_type', coalesce(o.node.`Node Type`, ''),
               'relation', nullif(o.node.`Relation Name`, ''), 'children', coalesce(size(o.node.Plans), 0)))),
            'open', flatten(transform(state.open, o -> transform(
               coalesce(o.node.Plans, CAST(array() AS array<string>)),
               (child, i) -> named_struct('path', concat(o.path, '.', i), 'node', from_json(child, '{_NODE}')))))),
          state -> state.done)
        """
    )


def flatten_plans(plans: DataFrame, column: str = "plan_json") -> DataFrame:
    """One row per plan node."""
    return plans.select(
        *[c for c in plans.columns if c != column], F.inline(plan_nodes(column))
    )


def table_frequency(nodes: DataFrame) -> DataFrame:
    """Plan nodes per relation; one statement can count a table several times."""
    return nodes.filter("relation IS NOT NULL").groupBy("relation").agg(F.count(F.lit(1)).alias("nodes"))


def scan_methods(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter("relation IS NOT NULL")
        .groupBy(F.concat_ws(":", "relation", "node_type").alias("scan"))
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def _is_join(node: Column) -> Column:
    return node["node_type"].isin(*JOIN_NODES) & (node["children"] >= 2)


def join_operators(nodes: DataFrame) -> DataFrame:
    """Join nodes with two children, per type."""
    joins = nodes.filter(F.col("node_type").isin(*JOIN_NODES) & (F.col("children") >= 2))
    return joins.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"))


def join_paths(plans: DataFrame, column: str = "plan_json") -> DataFrame:
    """How often two relations meet at a join node, as ``a|b`` in name order.

    Per node the distinct relations under the first child meet those under the
    second; later children are ignored. All of it stays in the plan's own row.
    """
    nodes = plans.select(plan_nodes(column).alias("nodes"))

    def under(node: Column, child: int) -> Column:
        root = F.concat(node["path"], F.lit(f".{child}"))
        inside = F.filter(
            "nodes",
            lambda n: n["relation"].isNotNull() & ((n["path"] == root) | n["path"].startswith(F.concat(root, F.lit(".")))),
        )
        return F.array_distinct(F.transform(inside, lambda n: n["relation"]))

    def pairs(node: Column) -> Column:
        def with_right(a: Column) -> Column:
            others = F.filter(under(node, 1), lambda b: b != a)
            return F.transform(others, lambda b: F.array_join(F.array_sort(F.array(a, b)), "|"))

        return F.flatten(F.transform(under(node, 0), with_right))

    met = F.flatten(F.transform(F.filter("nodes", _is_join), pairs))
    return nodes.select(F.explode(met).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("nodes"))


def static_join_keys(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Column equalities between two tables, counted per occurrence.

    Statements are counted by shape before names are looked for, so each shape is read once.
    """
    shapes = statements.groupBy(text.statement_shape(F.col(sql)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    keys = shapes.select("n", F.explode(text.join_keys(F.col("shape"))).alias("join_key"))
    return keys.groupBy("join_key").agg(F.sum("n").alias("n"))


def with_names(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``names``: struct<tables, columns, keys, words> of each statement.

    Names are looked for once per shape and joined back; a shape that many statements
    share, as templates and logs have, is a hot key of that join. NULL statements have NULL names.
    """
    shaped = statements.withColumn("__shape", text.statement_shape(F.col(sql)))
    shapes = shaped.select("__shape").filter("__shape IS NOT NULL").distinct()
    # A row more of the lookup is a shape more, however often it is used.
    named = shapes.select("__shape", text.statement_names(F.col("__shape")).alias("names"))
    return lookup_join(shaped, named, ["__shape"]).drop("__shape")


def accessed_tables(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``tables``: sorted, lower-cased, distinct table names of each statement."""
    return with_names(statements, sql).withColumn("tables", F.col("names.tables")).drop("names")


def inventory_arrays(inventory: DataFrame, db_id: str | Column = "db_id") -> DataFrame:
    """One row per database: its tables, its columns, and ``table.column`` names."""
    return inventory.groupBy(db_id).agg(
        F.array_sort(F.collect_set("table")).alias("known_tables"),
        F.array_sort(F.collect_set("column")).alias("known_columns"),
        F.array_sort(F.collect_set(F.concat_ws(".", "table", "column"))).alias("known_names"),
    )


def referenced_columns(statements: DataFrame, schema: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``tables`` and ``columns``: sorted, distinct names of the statement that
    the schema knows. ``schema`` is ``inventory_arrays``, a row per database."""
    known = with_names(statements, sql).join(schema, "db_id")
    return known.select(
        *statements.columns,
        F.array_intersect("names.tables", "known_tables").alias("tables"),
        F.array_sort(F.array_intersect("known_columns", "names.words")).alias("columns"),
    )


def schema_validity(predictions: DataFrame, schema: DataFrame, sql: str = "sql", by: str = "arm") -> DataFrame:
    """Per arm: statements that name a column the schema does not have."""
    shaped = predictions.groupBy(by, "db_id", text.statement_shape(F.col(sql)).alias("shape")).agg(
        F.count(F.lit(1)).alias("n")
    )
    unknown = F.size(F.array_except(text.qualified_columns(F.col("shape")), "known_names")) > 0
    # Unfolding keeps the two sums from looking for the names twice.
    judged = shaped.join(schema, "db_id").select(by, "n", F.explode(F.array(F.coalesce(unknown, F.lit(False)))).alias("unknown"))
    wrong = F.sum(F.when(F.col("unknown"), F.col("n")).otherwise(0))
    return judged.groupBy(by).agg(
        F.sum("n").alias("statements"),
        wrong.alias("invalid"),
        F.round(100 * wrong / F.sum("n").cast("double"), 6).alias("invalid_share"),
    )


def access_ranking(counters: DataFrame) -> DataFrame:
    """Tables by sequential plus index scans; a missing counter is 0."""
    total = F.coalesce("seq_scan", F.lit(0)) + F.coalesce("idx_scan", F.lit(0))
    return counters.withColumn("scans", total).orderBy(F.desc("scans"), "relation")


def scan_counters(nodes: DataFrame) -> DataFrame:
    """Counter table from plans: scans per relation, NULL when there is none."""
    def scans(prefix: str) -> Column:
        return F.nullif(F.count_if(F.col("node_type").startswith(prefix)), F.lit(0))

    return nodes.filter("relation IS NOT NULL").groupBy("relation").agg(
        scans("Seq").alias("seq_scan"), scans("Index").alias("idx_scan")
    )


def corpus_summary(outcomes: DataFrame, planned: Column) -> DataFrame:
    return outcomes.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(planned).alias("planned"), F.count_if(~planned).alias("failed")
    )


def first_failures(outcomes: DataFrame, planned: Column, order: Sequence[Column], k: int = 20) -> DataFrame:
    return top_per_group(outcomes.filter(~planned), ["db_id"], list(order), k)
