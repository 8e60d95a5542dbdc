"""SQL statements and model replies as columns.

Every function takes and returns columns built from JVM expressions only.
``\\w``, ``\\b`` and ``\\s`` are ASCII unless ``unicode=True`` is offered and set.
Trimming names its whitespace, because SQL ``trim`` alone leaves line breaks in
place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from qloom.functions.binding import let
from qloom.functions.scopes import scoped_names

# The patterns and word lists that decide results.
FENCED_BLOCK = r"(?is)^.*?```(?:sql)?\s*(.*?)```.*$"
STATEMENT_START = r"(?is)^.*?(\b(?:WITH|SELECT)\b.*)$"
EDGE_FENCES = r"(?i)^```(?:sql)?|```$"
EDGE_FENCES_AND_SPACE = r"(?i)^```(?:sql)?\s*|\s*```$"
WHITESPACE = " \t\n\r\f\v"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"--[^\n]*"
COMMENT_OR_LITERAL = r"(?s)/\*.*?\*/|--[^\n]*|'[^']*'"
COMMENT_LITERAL_OR_NAME = COMMENT_OR_LITERAL + r'|"[^"]*"|`[^`]*`'
QUERY_START = r"(?i)^[\s(]*(?:select|with)\b"
DANGLING_ENDS = ("WHERE", "JOIN", "FROM", "ON", "AND", "OR")
WRITE_VERBS = ("DROP", "DELETE", "UPDATE", "CREATE", "INSERT", "ALTER")
LEAK_KEY_STEPS = (
    (r"```sql|```", " "),
    (r"\bdistinct\b", " "),
    (r"\bas\s+[a-z_]\w*", " "),
    (r"\b[a-z_]\w*\.", ""),
    (r"\bas\b", " "),
    (r"\binner\s+join\b", "join"),
    (r"[\s();]+", " "),
    (r"\s*([=<>,])\s*", "$1"),
    (r"\s+", " "),
)
# The same steps: fences before and brackets behind these need no pattern, and only texts that hold one of the
# marks are changed by these. No step brings a mark in.
LEAK_KEY_MARKS = ("distinct", "as", ".", "inner")
LEAK_KEY_WORDS = (
    (r"\bdistinct\b", " "),
    (r"\bas\s+[a-z_]\w*", " "),
    (r"\b[a-z_]\w*+\.", ""),
    (r"\bas\b", " "),
    (r"\binner\s+join\b", "join"),
)
LEAK_KEY_SPACES = ((r"\s*+([=<>,])\s*+", "$1"), (r"\s+", " "))
SELECT_STAR = r"(?is)(?:\bselect\s+(?:all\s+|distinct\s+)?|,\s*|\.)\*"
LOGIC_WORDS = r"(?i)\b(?:where|group|join|order)\b"
AGGREGATE_CALL = r"(?i)\b(?:count|sum|avg|min|max|stddev|variance|array_agg|string_agg)\s*\("
COMMA_JOIN = r"(?is)\bfrom\s+[\w\".]+(?:\s+(?:as\s+)?\w+)?\s*,"
CLAUSE_KEYWORD = r"(?i)\s+(?:WHERE|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT)\s+"
WORD = r"(?i)\b[a-z_]\w*\b"


def _drop(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    """Trim all whitespace at both ends, line breaks included."""
    return F.btrim(text, F.lit(WHITESPACE))


def _without_terminator(text: Column) -> Column:
    return strip(F.rtrim(strip(text), F.lit(";")))


def extract_sql(reply: Column) -> Column:
    """The first SQL statement of a model reply, or the reply itself if it has none."""
    # A pattern that does not match leaves the text as it is.
    text = strip(_drop(strip(reply), FENCED_BLOCK, "$1"))
    return _without_terminator(_drop(text, STATEMENT_START, "$1"))


def extract_after_marker(reply: Column, marker: str = "SQL:") -> Column:
    """The statement after the last marker, so a SELECT inside reasoning is not taken."""
    return extract_sql(F.substring_index(reply, marker, -1))


def strip_comments(sql: Column) -> Column:
    """Remove block and line comments, then fences at the edges."""
    text = _drop(_drop(sql, BLOCK_COMMENT), LINE_COMMENT)
    return strip(_drop(strip(text), EDGE_FENCES_AND_SPACE))


def sanitize_sql(sql: Column) -> Column:
    """Rewrite shapes PostgreSQL refuses. Off by default everywhere: it is known
    to damage some valid statements."""
    distinct_order = (
        r"(?is)SELECT\s+DISTINCT\s+(.*?)\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(.*?)(LIMIT\s+\d+)?;"
    )
    text = strip(_drop(strip(sql), r"(?i)^```[a-z]*|```$"))

    def part(group: int) -> Column:
        return F.regexp_extract(text, distinct_order, group)

    wrapped = F.concat(
        F.lit("SELECT * FROM (SELECT DISTINCT "), part(1), F.lit(" FROM "), part(2),
        F.lit(") sub ORDER BY "), part(3), F.lit(" "), part(4), F.lit(";"),
    )
    text = F.when(text.rlike(distinct_order), wrapped).otherwise(text)
    text = _drop(text, r"(?i)CAST\(([^\n]*?)\s+AS\s+REAL\)", "$1::REAL")
    text = _drop(text, r"(?i)NULLIF\(NULLIF,0\)\(([^\n]*?)\)", "NULLIF($1,0)")
    return _drop(text, r"\n\s*\n", "\n")


def is_complete(sql: Column) -> Column:
    """Has SELECT and FROM and does not stop at a clause word. The end test looks
    at characters, so a name ending in "on" counts as incomplete."""
    text = strip(F.upper(sql))
    dangling = text.rlike("(?:" + "|".join(DANGLING_ENDS) + ")$")
    return text.contains("SELECT") & text.contains("FROM") & ~dangling


def without_literals(sql: Column) -> Column:
    """The statement with every comment and string literal blanked in one pass, so
    a dash inside a literal starts no comment and a quote in a comment no literal."""
    return _drop(sql, COMMENT_OR_LITERAL, " ")


def is_read_only(sql: Column) -> Column:
    """A query: it starts with SELECT or WITH and has no writing verb outside comments,
    literals and quoted names."""
    bare = _drop(sql, COMMENT_LITERAL_OR_NAME, " ")
    return bare.rlike(QUERY_START) & ~bare.rlike(r"(?i)\b(?:" + "|".join(WRITE_VERBS) + r")\b")


def is_valid(sql: Column) -> Column:
    return is_complete(sql) & is_read_only(sql)


def clean_fence_edges(reply: Column) -> Column:
    """Drop a fence at the very start and at the very end, nothing else."""
    return strip(_drop(strip(reply), EDGE_FENCES))


def normalize_sql(sql: Column) -> Column:
    return _without_terminator(_drop(strip(sql), EDGE_FENCES))


def fingerprint(sql: Column) -> Column:
    """Duplicate key: case and whitespace do not count."""
    return strip(_drop(F.lower(sql), r"\s+", " "))


def leak_key(sql: Column, unicode: bool = False) -> Column:
    """Key under which two statements with equal literals are the same query,
    whatever their aliases, qualifiers, parentheses and spacing."""
    flags = "(?U)" if unicode else ""
    bare = F.replace(F.replace(F.lower(sql), F.lit("```sql"), F.lit(" ")), F.lit("```"), F.lit(" "))
    text = bare
    for pattern, replacement in LEAK_KEY_WORDS:
        text = _drop(text, flags + pattern, replacement)
    marked = reduce(Column.__or__, [bare.contains(mark) for mark in LEAK_KEY_MARKS])
    text = F.translate(F.when(marked, text).otherwise(bare), "();", "   ")
    for pattern, replacement in LEAK_KEY_SPACES:
        text = _drop(text, flags + pattern, replacement)
    return strip(text)


def is_trivial(sql: Column) -> Column:
    """A star projection with no filter, grouping, join, order or aggregate."""

    def judge(bare: Column) -> Column:
        logic = bare.rlike(LOGIC_WORDS) | bare.rlike(AGGREGATE_CALL) | bare.rlike(COMMA_JOIN)
        return bare.rlike(SELECT_STAR) & ~logic

    # Most statements have no star at all and skip the patterns.
    return sql.contains("*") & let(without_literals(sql), judge)


def comparable(sql: Column) -> Column:
    """Text under which two predictions agree; NULL counts as empty."""
    text = F.rtrim(strip(F.coalesce(sql, F.lit(""))), F.lit(";"))
    return F.lower(_drop(text, r"\s+", " "))


def statement_names(sql: Column) -> Column:
    """struct<tables, columns, keys, words>: names by scope, see ``scopes.scoped_names``."""
    return scoped_names(without_literals(sql))


def statement_shape(sql: Column) -> Column:
    """The statement without comments, literals and numbers: statements of one shape name
    the same tables and columns."""
    return strip(_drop(without_literals(sql), r"\b\d[\w.]*", "0"))


def accessed_tables(sql: Column) -> Column:
    """Sorted, lower-cased, distinct table names."""
    return statement_names(sql)["tables"]


def join_keys(sql: Column) -> Column:
    """array<string> of ``t.c = u.c``, one per column equality between two tables."""
    return statement_names(sql)["keys"]


def words(sql: Column) -> Column:
    """Identifiers and keywords of a statement, literals left out."""
    return F.regexp_extract_all(without_literals(sql), F.lit(WORD), F.lit(0))


def qualified_columns(sql: Column) -> Column:
    """array<string> of ``table.column`` with aliases resolved; unknown aliases are left out."""
    return statement_names(sql)["columns"]


def truncate_text(value: Column, limit: int = 120) -> Column:
    """Longer text becomes its first ``limit`` characters and an ellipsis."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)


def verdict(reply: Column, clear: str, unclear: str) -> Column:
    """struct<status, reason>: OK means ``clear``, any other text is the reason why not."""
    text = strip(reply)
    return (
        F.when(reply.isNull(), F.struct(F.lit("error").alias("status"), F.lit(None).cast("string").alias("reason")))
        .when(F.lower(text) == "ok", F.struct(F.lit(clear).alias("status"), F.lit(None).cast("string").alias("reason")))
        .otherwise(F.struct(F.lit(unclear).alias("status"), text.alias("reason")))
    )


def lines(parts: Sequence[Column], separator: str = "\n") -> Column:
    return F.concat_ws(separator, *parts)
