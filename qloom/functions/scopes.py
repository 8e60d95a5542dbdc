"""Names of a statement by scope: one pass over its tokens with a stack of open parentheses.

Every SELECT opens a scope, whose path starts with the path of the SELECT around it. A qualifier
means the table declared under that name in the innermost scope around it, so a subquery
may use an alias anew. The pass is a fold in the row's own expression; no rows are made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qloom.functions.binding import let

# SQL words by what they mean to the pass.
ENDS_TABLES = (
    "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "WINDOW", "QUALIFY", "UNION", "EXCEPT", "INTERSECT", "MINUS",
    "FETCH", "OFFSET", "FOR", "SET", "VALUES", "RETURNING",
)
CONDITION = ("ON", "USING")
NEVER_A_NAME = (
    "WITH", "RECURSIVE", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "RLIKE", "SIMILAR", "BETWEEN", "CASE",
    "WHEN", "THEN", "ELSE", "END", "BY", "ASC", "DESC", "NULLS", "EXISTS", "ANY", "SOME", "ALL", "OVER", "PARTITION",
    "ROWS", "RANGE", "PRECEDING", "FOLLOWING", "UNBOUNDED", "TRUE", "FALSE", "INTERVAL", "ESCAPE", "COLLATE", "LATERAL",
    "VIEW", "ONLY", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "SEMI", "ANTI", "TABLESAMPLE",
    "FILTER", "WITHIN", "CAST", "TO", "BOTH", "LEADING", "TRAILING", "MATERIALIZED",
)
_PART = r"""(?:[a-z_][\w$]*|"[^"]+"|`[^`]+`)"""
TOKEN = rf"(?i){_PART}(?:\s*\.\s*(?:{_PART}|\*))*|[(),]|[-+*/%|<>!=:\[]+"

# Kinds of tokens. Those from DISTINCT on are looked at by their neighbours only.
OPEN, CLOSE, COMMA, SELECT, FROM, JOIN, COND, END, WORD, COLUMN, CALL, EQUAL, ALIAS = range(13)
DISTINCT, AS, OPERATOR, SAME, OTHER = range(13, 18)
# What a frame of the stack is reading: an expression, a table to come, a table that may get an alias, or one that has it.
EXPRESSION, WANTED, NAMED, DONE = range(4)

_FIELDS = ("stack", "scopes", "tables", "columns", "keys", "words")
_START = """named_struct(
  'stack', array(named_struct('base', '/', 'path', '/', 'reads', 0, 'own', true, 'last', CAST(NULL AS string))),
  'scopes', 0,
  'tables', CAST(array() AS array<struct<path: string, alias: string, name: string>>),
  'columns', CAST(array() AS array<struct<path: string, alias: string, name: string>>),
  'keys', CAST(array() AS array<struct<path: string, left: string, right: string>>),
  'words', CAST(array() AS array<string>))"""


def _classed(token: Column) -> Column:
    """struct<kind, text> of one token by itself."""
    first = F.substring(token, 1, 1)
    upper = F.upper(token)
    symbol = (
        F.when(token == "(", OPEN)
        .when(token == ")", CLOSE)
        .when(token == ",", COMMA)
        .when(token.isin("=", "=="), SAME)
        .when(first.isin(*"-+*/%|<>!=:["), OPERATOR)
    )
    word = (
        F.when(token.endswith("*"), OTHER)
        .when(token.contains("."), COLUMN)
        .when(first.isin('"', "`"), WORD)
        .when(upper.isin(*NEVER_A_NAME), OTHER)
        .when(upper.isin(*ENDS_TABLES), END)
        .when(upper == "AS", AS)
        .when(upper == "SELECT", SELECT)
        .when(upper == "FROM", FROM)
        .when(upper == "JOIN", JOIN)
        .when(upper.isin(*CONDITION), COND)
        .when(upper == "DISTINCT", DISTINCT)
        .otherwise(WORD)
    )
    odd = token.contains('"') | token.contains("`") | token.contains(" ")
    plain = F.when(odd, F.regexp_replace(token, F.lit(r"\s*(\.)\s*|[\"`]"), F.lit("$1"))).otherwise(token)
    return F.struct(F.coalesce(symbol, word).alias("kind"), plain.alias("text"))


def _tokens(bare: Column) -> Column:
    """array<struct<kind, text>>: the tokens that decide about names."""

    def settled(found: Column) -> Column:
        def among(token: Column, at: Column) -> Column:
            def kind_at(step: int) -> Column:
                return F.coalesce(F.get(found, at + step)["kind"], F.lit(OTHER))

            kind = token["kind"]
            named = kind_at(-1).isin(WORD, COLUMN)
            # Two columns that are equal as they stand; as part of a longer term they are not.
            alone = (kind_at(-1) == COLUMN) & (kind_at(1) == COLUMN) & (kind_at(-2) != OPERATOR)
            alone = alone & ~kind_at(2).isin(OPERATOR, OPEN)
            sides = F.concat(F.get(found, at - 1)["text"], F.lit("="), F.get(found, at + 1)["text"])
            new = (
                F.when(kind == WORD, F.when(kind_at(1) == OPEN, CALL).when(named | kind_at(-1).isin(CLOSE, AS), ALIAS).otherwise(WORD))
                .when(kind == COLUMN, F.when(kind_at(1) == OPEN, CALL).otherwise(COLUMN))
                .when(kind == OPEN, F.when(named, OTHER).otherwise(OPEN))
                .when(kind == FROM, F.when(kind_at(-1) == DISTINCT, OTHER).otherwise(FROM))
                .when(kind == SAME, F.when(alone, EQUAL).otherwise(OTHER))
                .otherwise(kind)
            )
            return F.struct(new.alias("kind"), F.when(kind == SAME, sides).otherwise(token["text"]).alias("text"))

        return F.filter(F.transform(found, among), lambda t: t["kind"] < DISTINCT)

    return let(F.transform(F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0)), _classed), settled)


def _with(state: Column, **new: Column) -> Column:
    return F.struct(*[new.get(f, state[f]).alias(f) for f in _FIELDS])


def _frame(top: Column, **new: Column) -> Column:
    return F.struct(*[new.get(f, top[f]).alias(f) for f in ("base", "path", "reads", "own", "last")])


def _replaced(stack: Column, frame: Column) -> Column:
    return F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame))


def _part(name: Column, at: int) -> Column:
    """A part of a dotted name, counted from the right."""
    return F.substring_index(F.substring_index(name, ".", -at), ".", 1)


def _no_name() -> Column:
    return F.lit(None).cast("string")


def _step(state: Column, token: Column) -> Column:
    def next_state(top: Column) -> Column:
        stack, kind, text, reads = state["stack"], token["kind"], token["text"], top["reads"]

        def reading(what: int, **new: Column) -> Column:
            return _replaced(stack, _frame(top, reads=F.lit(what), **new))

        def inside(below: Column, what: Column) -> Column:
            frame = F.struct(
                top["path"].alias("base"),
                top["path"].alias("path"),
                what.alias("reads"),
                F.lit(False).alias("own"),
                _no_name().alias("last"),
            )
            return F.concat(below, F.array(frame))

        def declared(alias: Column, name: Column) -> Column:
            entry = F.struct(top["path"].alias("path"), alias.alias("alias"), name.alias("name"))
            return F.concat(state["tables"], F.array(entry))

        def mentioned(name: Column) -> Column:
            entry = F.struct(top["path"].alias("path"), _part(name, 2).alias("alias"), _part(name, 1).alias("name"))
            return F.concat(state["columns"], F.array(entry))

        def closed() -> Column:
            def settle(outer: Column) -> Column:
                # A parenthesis that stood for a table may get an alias.
                stood = outer["reads"] == WANTED
                frame = _frame(
                    outer,
                    reads=F.when(stood, NAMED).otherwise(outer["reads"]),
                    last=F.when(stood, _no_name()).otherwise(outer["last"]),
                )
                return F.concat(F.slice(stack, F.lit(1), F.size(stack) - 2), F.array(frame))

            return F.when(F.size(stack) < 2, state).otherwise(
                _with(state, stack=let(F.element_at(stack, -2), settle))
            )

        expression = F.lit(EXPRESSION)
        # A call where a table is due gives a nameless one; behind a table, it is an alias with column names.
        called = (
            F.when(reads == WANTED, _with(state, stack=inside(reading(NAMED, last=_no_name()), expression)))
            .when(
                reads == NAMED,
                _with(state, stack=inside(reading(DONE), expression), tables=declared(text, top["last"])),
            )
            .otherwise(_with(state, stack=inside(stack, expression)))
        )
        path = F.concat(top["base"], state["scopes"].cast("string"), F.lit("/"))
        key = F.struct(
            top["path"].alias("path"),
            F.substring_index(text, "=", 1).alias("left"),
            F.substring_index(text, "=", -1).alias("right"),
        )
        name = _part(text, 1)
        return (
            F.when(
                (reads == WANTED) & kind.isin(WORD, ALIAS, COLUMN),
                _with(state, stack=reading(NAMED, last=name), tables=declared(name, name)),
            )
            .when(
                (reads == NAMED) & kind.isin(WORD, ALIAS),
                _with(state, stack=reading(DONE), tables=declared(text, top["last"])),
            )
            .when(kind == COLUMN, _with(state, columns=mentioned(text)))
            .when(kind == WORD, _with(state, words=F.concat(state["words"], F.array(text))))
            .when(kind == ALIAS, state)
            .when(kind == COMMA, F.when(reads >= NAMED, _with(state, stack=reading(WANTED))).otherwise(state))
            .when(kind == CALL, called)
            # A parenthesis where a table is due holds a subquery or joined tables.
            .when(kind == OPEN, _with(state, stack=inside(stack, F.when(reads == WANTED, WANTED).otherwise(EXPRESSION))))
            .when(kind == CLOSE, closed())
            .when(
                kind == SELECT,
                _with(state, scopes=state["scopes"] + 1, stack=reading(EXPRESSION, path=path, own=F.lit(True))),
            )
            # FROM inside a call names no table.
            .when(kind == FROM, F.when(top["own"], _with(state, stack=reading(WANTED))).otherwise(state))
            .when(kind == EQUAL, _with(state, keys=F.concat(state["keys"], F.array(key))))
            .when(kind == JOIN, _with(state, stack=reading(WANTED)))
            .when(kind == COND, F.when(reads >= WANTED, _with(state, stack=reading(DONE))).otherwise(state))
            .otherwise(_with(state, stack=reading(EXPRESSION)))
        )

    return let(F.element_at(state["stack"], -1), next_state)


def _table_of(tables: Column, path: Column, alias: Column) -> Column:
    """The table an alias means at a path: of the scopes around it the innermost that declares
    the alias, and there the last declaration. NULL for subqueries, calls and unknown aliases."""
    around = F.filter(tables, lambda t: (t["alias"] == alias) & path.startswith(t["path"]))
    ranked = F.transform(
        around, lambda t, i: F.struct(F.length(t["path"]).alias("depth"), i.alias("at"), t["name"].alias("name"))
    )
    return F.array_max(ranked)["name"]


def scoped_names(bare: Column) -> Column:
    """struct<tables, columns, keys, words> of a statement without comments and literals.

    tables: sorted, distinct, lower-cased; the names of common table expressions count where they are
    read. columns: distinct ``table.column`` of qualified names, aliases resolved. keys: one
    ``t.c = u.c`` per equality of two columns of different tables, sides in order. words: names
    without a qualifier where a column can stand. Names whose qualifier is a subquery, a call or
    unknown are in no list but that of their bare columns.
    """

    def resolved(state: Column) -> Column:
        tables = state["tables"]
        names = F.array_compact(F.transform(tables, lambda t: F.lower(t["name"])))
        columns = F.transform(
            state["columns"], lambda c: F.concat(_table_of(tables, c["path"], c["alias"]), F.lit("."), c["name"])
        )

        def key(k: Column) -> Column:
            ends = F.transform(
                F.array(k["left"], k["right"]),
                lambda side: F.struct(
                    _table_of(tables, k["path"], _part(side, 2)).alias("table"), _part(side, 1).alias("column")
                ),
            )

            def joined(e: Column) -> Column:
                text = F.array_join(
                    F.array_sort(F.transform(e, lambda x: F.concat_ws(".", x["table"], x["column"]))), " = "
                )
                # NULL where a table is unknown, or both are the same.
                return F.when(e[0]["table"] != e[1]["table"], text)

            return let(ends, joined)

        return F.struct(
            F.array_sort(F.array_distinct(names)).alias("tables"),
            F.array_distinct(F.array_compact(columns)).alias("columns"),
            F.array_compact(F.transform(state["keys"], key)).alias("keys"),
            F.array_distinct(
                F.concat(state["words"], F.transform(state["columns"], lambda c: c["name"]))
            ).alias("words"),
        )

    return let(F.aggregate(_tokens(bare), F.expr(_START), _step), resolved)
