"""Schemas as prompt text, their size, and whether they suffice.

Inputs are schema-sized: one row per column. Lists are collected per table and
per database, so they are bounded by the schema and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.functions.tokens import token_count

MAX_EXAMPLES = 3  # fixed value
NOTHING_DECLARED = "  nothing declared: join on columns that share a name"


def ordered_text(order: Column, line: Column, separator: str) -> Column:
    """Aggregate: lines joined in the given order."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.array_join(F.transform(entries, lambda e: e["l"]), separator)


def examples_text(values: Column, is_text: Column) -> Column:
    """Up to three example values, text in quotes."""
    few = F.slice(values, 1, MAX_EXAMPLES)
    return F.array_join(
        F.transform(few, lambda v: F.when(is_text, F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v)), ", "
    )


def first_filled(*candidates: Column) -> Column:
    """The first of several arrays that has an element: sample, then all, then common values."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates])


def render_mschema(columns: DataFrame, edges: DataFrame, db_id: str) -> DataFrame:
    """One row (db_id, text).

    ``columns``: table, table_order, ordinal, column, type, nullable, is_key,
    comment, examples (array, may be NULL), is_text. ``edges``: position, table,
    column, to_table, to_column.
    """
    entry = F.concat_ws(
        ", ",
        F.concat("column", F.lit(":"), "type"),
        F.when(F.col("is_key"), F.lit("Primary Key")),
        F.when(~F.col("nullable"), F.lit("NOT NULL")),
        F.col("comment"),
    )
    shown = F.when(
        F.size("examples") > 0,
        F.concat(F.lit(". Examples: ["), examples_text(F.col("examples"), F.col("is_text")), F.lit("]")),
    )
    line = F.concat(F.lit("("), entry, F.coalesce(shown, F.lit("")), F.lit("),"))
    tables = columns.groupBy("table", "table_order").agg(ordered_text(F.col("ordinal"), line, "\n").alias("body"))
    block = F.concat(F.lit("# Table: "), "table", F.lit("\n[\n"), "body", F.lit("\n]"))
    body = tables.agg(ordered_text(F.col("table_order"), block, "\n").alias("body"))
    link = F.concat("table", F.lit("."), "column", F.lit(" = "), "to_table", F.lit("."), "to_column")
    links = edges.agg(ordered_text(F.col("position"), link, "\n").alias("links")).select("links").scalar()
    return body.withColumn("links", links).select(
        F.lit(db_id).alias("db_id"),
        F.concat(
            F.lit(f"【DB_ID】 {db_id}\n【Schema】\n"),
            "body",
            F.when(F.col("links") != "", F.concat(F.lit("\n【Foreign keys】\n"), "links")).otherwise(F.lit("")),
            F.lit("\n"),
        ).alias("text"),
    )


def table_lines(columns: DataFrame) -> DataFrame:
    """(table, table_order, line): ``table(col type, col type)``."""
    cells = ordered_text(F.col("ordinal"), F.concat_ws(" ", "column", "type"), ", ")
    return columns.groupBy("table", "table_order").agg(
        F.concat(F.first("table"), F.lit("("), cells, F.lit(")")).alias("line")
    )


def compact_schema(columns: DataFrame, db_id: str, edges: DataFrame | None = None) -> DataFrame:
    """One row (db_id, text, tables, edges): a line per table and, when edges are
    given, how the tables connect (declared ones first, implied ones marked)."""
    text = table_lines(columns).agg(
        ordered_text(F.col("table_order"), F.col("line"), "\n").alias("text"), F.count(F.lit(1)).alias("tables")
    )
    if edges is None:
        return text.select(F.lit(db_id).alias("db_id"), "text", "tables", F.lit(0).cast("bigint").alias("edges"))
    arrow = F.concat(
        F.lit("  "), "table", F.lit("."), "column", F.lit(" -> "), "to_table", F.lit("."), "to_column",
        F.when(F.col("implied"), F.lit("  (same column name)")).otherwise(F.lit("")),
    )
    listed = edges.agg(
        ordered_text(F.struct("implied", "position"), arrow, "\n").alias("links"), F.count(F.lit(1)).alias("n")
    ).select(F.struct("links", "n").alias("s"))
    return text.withColumn("s", listed.scalar()).select(
        F.lit(db_id).alias("db_id"),
        F.concat(
            "text",
            F.lit("\n\nJoins between tables:\n"),
            F.when(F.col("s.n") > 0, F.col("s.links")).otherwise(F.lit(NOTHING_DECLARED)),
        ).alias("text"),
        "tables",
        F.col("s.n").alias("edges"),
    )


def profile_size(schemas: DataFrame) -> DataFrame:
    """Tables, edges and tokens of each database's schema text."""
    return schemas.groupBy("db_id").agg(
        F.sum("tables").alias("tables"), F.sum("edges").alias("edges"), F.sum(token_count(F.col("text"))).alias("tokens")
    )


def profile_coverage(outcomes: DataFrame, ran: Column, reason: Column) -> DataFrame:
    """Per database and failing reason (NULL: ran): queries and their share."""
    counts = outcomes.groupBy("db_id", F.when(~ran, reason).alias("reason")).agg(F.count(F.lit(1)).alias("queries"))
    totals = counts.groupBy("db_id").agg(F.sum("queries").alias("total"))
    return counts.join(totals, "db_id").select(
        "db_id", "reason", "queries", F.round(100 * F.col("queries") / F.col("total"), 4).alias("share")
    )
