"""Training records, prompts and requests made from curated pairs.

Wording is never fixed here: templates come in as text with ``{db_id}``,
``{question}``, ``{sql}``, ``{evidence}`` or ``{schema}`` in it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.functions import text
from qloom.functions.binding import let
from qloom.functions.tokens import token_count
from qloom.operators.workload import referenced_columns
from qloom.plans import first_by_hash, hash_key, lookup_join, top_per_group

# Fixed values.
SQL_MARKER = "\nSQL:\n"
TOKEN_LIMIT = 512
REASONING_TOKEN_LIMIT = 640
PAIRS_PER_CALL = 8
FEWSHOT = 3
FOCUS_TABLES = 3
REQUEST_CHUNK = 1000

DEFAULT_TEMPLATES = {
    "sql_generation": "Database `{db_id}`. Answer with one SQL statement.",
    "schema_linking": "Database `{db_id}`. List the tables and columns the question needs.",
    "noise_correction": "Database `{db_id}`. One column of this statement is wrong. Answer with the right statement.",
    "continuation_writing": "Database `{db_id}`. Finish the statement. Answer with the missing part.",
}
ASKED = "Question: {question}\nHint: {evidence}"


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Template text with ``{name}`` replaced by columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def _record(rows: DataFrame, task: str, user: Column, target: Column, templates: Mapping[str, str]) -> DataFrame:
    return rows.select(
        "pair_id",
        "db_id",
        F.lit(task).alias("task"),
        fill(templates[task], {"db_id": F.col("db_id")}).alias("system"),
        user.alias("user"),
        target.alias("target"),
        F.lit("derived").alias("source"),
    )


def schema_linking_task(pairs: DataFrame, schema: DataFrame, templates: Mapping[str, str] = DEFAULT_TEMPLATES) -> DataFrame:
    """Question to the tables and columns its statement uses; rows lacking either go."""
    known = referenced_columns(pairs, schema).filter((F.size("tables") > 0) & (F.size("columns") > 0))
    target = F.concat(
        F.lit("tables: "), F.array_join("tables", ", "), F.lit("\ncolumns: "), F.array_join("columns", ", ")
    )
    return _record(known, "schema_linking", F.col("question"), target, templates)


def _drawn(options: Column, seed: object, key: Column) -> Column:
    """One element of an array, picked by hash."""
    marked = F.transform(
        options, lambda o: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit("|"), o)).alias("h"), o.alias("o"))
    )
    return F.array_min(marked)["o"]


def noise_correction_task(
    pairs: DataFrame, schema: DataFrame, seed: object = 0, templates: Mapping[str, str] = DEFAULT_TEMPLATES
) -> DataFrame:
    """A statement with one referenced column swapped for another column of the
    same database; the target is the original. Unchanged rows go."""
    def swapped(victim: Column) -> Column:
        others = F.filter("known_columns", lambda c: c != victim)
        # The first mention outside literals and comments; the possessive loop never steps back into one.
        name = F.concat(F.lit(r"\b\Q"), victim, F.lit(r"\E\b"))
        before = F.concat(F.lit(r"(?s)^((?:'[^']*'|--[^\n]*|/\*.*?\*/|(?!"), name, F.lit(r")[^'])*+)"))
        other = F.replace(F.replace(_drawn(others, f"{seed}|other", F.col("pair_id")), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(F.col("sql"), F.concat(before, name), F.concat(F.lit("$1"), other))

    used = F.array_intersect("known_columns", text.words(F.col("sql")))
    broken = let(_drawn(used, f"{seed}|victim", F.col("pair_id")), swapped)
    noisy = (
        pairs.join(schema, "db_id")
        # Unfolding keeps the filter behind the swap, which is then computed once.
        .select(*pairs.columns, F.explode(F.array(broken)).alias("__broken"))
        .filter(text.strip(F.lower("__broken")) != text.strip(F.lower("sql")))
    )
    user = F.concat(F.lit("question: "), "question", F.lit("\nSQL: "), "__broken")
    return _record(noisy, "noise_correction", user, F.col("sql"), templates)


def cut_at_middle_clause(sql: Column) -> Column:
    """array<struct<prefix, suffix>>: the statement cut in front of its middle
    clause keyword; empty when it has none."""

    def halves(keywords: Column) -> Column:
        middle = F.floor(F.size(keywords) / 2).cast("int")
        pieces = F.slice(F.split(sql, text.CLAUSE_KEYWORD), F.lit(1), middle + 1)
        between = F.slice(keywords, F.lit(1), middle)
        length = F.length(F.array_join(pieces, "")) + F.length(F.array_join(between, ""))
        cut = let(
            length,
            lambda at: F.struct(
                text.strip(F.substring(sql, F.lit(1), at)).alias("prefix"),
                text.strip(F.substring(sql, at + 1, F.length(sql))).alias("suffix"),
            ),
        )
        return F.when(F.size(keywords) > 0, F.array(cut))

    return let(F.regexp_extract_all(sql, F.lit(text.CLAUSE_KEYWORD), F.lit(0)), halves)


def continuation_task(pairs: DataFrame, templates: Mapping[str, str] = DEFAULT_TEMPLATES) -> DataFrame:
    """The head of a statement in the prompt, its tail as target."""
    cut = pairs.select(*pairs.columns, F.inline(cut_at_middle_clause(F.col("sql")))).filter(
        (F.col("prefix") != "") & (F.col("suffix") != "")
    )
    user = F.concat(F.lit("question: "), "question", F.lit("\nSQL so far: "), "prefix")
    return _record(cut, "continuation_writing", user, F.col("suffix"), templates)


def derive_tasks(
    train: DataFrame,
    schema: DataFrame,
    fractions: Mapping[str, float] | None = None,
    seed: object = 0,
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
) -> DataFrame:
    """Auxiliary records: per database an independent sample of ``round(n * fraction)``
    training pairs for each task. Databases without a profile are skipped."""
    fractions = fractions or {"schema_linking": 0.5, "noise_correction": 0.5, "continuation_writing": 0.5}
    profiled = train.join(schema.select("db_id"), "db_id", "left_semi")

    def sample(task: str) -> DataFrame:
        fraction = fractions[task]
        return first_by_hash(profiled, ["db_id"], "pair_id", lambda n: F.bround(n * fraction, 0), f"{seed}|{task}")

    return (
        schema_linking_task(sample("schema_linking"), schema, templates)
        .unionByName(noise_correction_task(sample("noise_correction"), schema, seed, templates))
        .unionByName(continuation_task(sample("continuation_writing"), templates))
    )


def assemble_reasoning(pairs: DataFrame, reasoning: str = "reasoning") -> DataFrame:
    """Reasoning, marker and statement as one target; rows without reasoning go."""
    trimmed = text.strip(F.col(reasoning))
    return (
        pairs.filter(F.coalesce(trimmed, F.lit("")) != "")
        .withColumn("target", F.concat(trimmed, F.lit(SQL_MARKER), "sql"))
        .withColumn("task", F.lit("reasoning_sql"))
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_text(messages: Column, turn: str = "<|{role}|>\n{content}\n") -> Column:
    """Messages rendered through a per-turn template."""
    return F.array_join(F.transform(messages, lambda m: fill(turn, {"role": m["role"], "content": m["content"]})), "")


def render_chat(
    records: DataFrame,
    turn: str = "<|{role}|>\n{content}\n",
    opening: str = "<|assistant|>\n",
    end: str = "<|end|>",
    templates: Mapping[str, str] = DEFAULT_TEMPLATES,
) -> DataFrame:
    """Adds ``messages`` and ``text``. Generation records get the line naming the
    database and the bare question; other tasks bring their own system, user and
    target. The answer follows the opened assistant turn."""
    plain = F.coalesce("task", F.lit("sql_generation")) == "sql_generation"
    system = F.when(plain, fill(templates["sql_generation"], {"db_id": F.col("db_id")})).otherwise(F.col("system"))
    user = F.when(plain, F.col("question")).otherwise(F.col("user"))
    answer = F.when(plain, F.col("sql")).otherwise(F.col("target"))
    messages = F.array(message("system", system), message("user", user))
    return records.withColumn("messages", messages).withColumn(
        "text", F.concat(chat_text(F.col("messages"), turn), F.lit(opening), answer, F.lit(end))
    )


def render_turns(turns: DataFrame, turn: str = "<|{role}|>\n{content}\n") -> DataFrame:
    """Stored conversations, rendered turn by turn: one row per turn, so a very long
    conversation is never gathered in one place."""
    return turns.withColumn("rendered", fill(turn, {"role": F.col("role"), "content": F.col("text")}))


def build_prompts(
    questions: DataFrame,
    schemas: DataFrame | None = None,
    system: str = DEFAULT_TEMPLATES["sql_generation"],
    user: str = ASKED,
) -> DataFrame:
    """Adds ``system`` and ``user``. With schemas (db_id, text) the schema follows
    the system line. Question rows of a hot database are spread by the lookup."""
    line = fill(system, {"db_id": F.col("db_id")})
    request = fill(user, {"question": F.col("question"), "evidence": F.col("evidence")})
    if schemas is None:
        return questions.withColumns({"system": line, "user": request})
    joined = lookup_join(questions, schemas.select("db_id", F.col("text").alias("__schema")), ["db_id"])
    with_schema = F.concat(line, F.lit("\n\nSchema:\n"), F.coalesce("__schema", F.lit("")))
    return joined.withColumns({"system": with_schema, "user": request}).drop("__schema")


def fewshot(pairs: DataFrame, databases: DataFrame, k: int = FEWSHOT, seed: object = 0) -> DataFrame:
    """(db_id, text): up to ``k`` pairs of each database, empty text when it has none."""
    ranked = pairs.select("db_id", "question", "sql", hash_key(seed, F.col("pair_id")).alias("__h"))
    picked = top_per_group(ranked, ["db_id"], [F.col("__h")], k)
    shown = F.concat(F.lit("  Q: "), "question", F.lit("\n  SQL: "), "sql")
    texts = picked.groupBy("db_id").agg(
        F.concat(
            F.lit("Examples:\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", shown.alias("t")))), lambda s: s["t"]), "\n"),
            F.lit("\n"),
        ).alias("text")
    )
    return databases.join(texts, "db_id", "left").select("db_id", F.coalesce("text", F.lit("")).alias("text"))


def request_plan(
    databases: DataFrame, themes: Sequence[str], per_call: int = PAIRS_PER_CALL, focus: int = FOCUS_TABLES, seed: object = 0
) -> DataFrame:
    """One row per model request: ``ceil(target / per_call)`` per database, themes in
    turn, and a few focus tables drawn by hash.

    ``databases`` is (db_id, target, tables: array). Requests are unfolded in
    chunks that are spread over the cluster before they multiply.
    """
    calls = F.ceil(F.col("target") / per_call).cast("bigint")
    chunks = (
        databases.withColumn("__calls", calls)
        .filter("__calls > 0")
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__calls") - 1) / REQUEST_CHUNK))))
        .repartition("db_id", "__chunk")
    )
    start = F.col("__chunk") * REQUEST_CHUNK
    rows = chunks.withColumn(
        "request", F.explode(F.sequence(start, F.least(start + REQUEST_CHUNK, F.col("__calls")) - 1))
    )
    key = F.concat_ws("|", F.col("db_id"), F.col("request").cast("string"))
    marked = F.transform(
        "tables", lambda t: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), key, F.lit("|"), t)).alias("h"), t.alias("t"))
    )
    chosen = F.transform(F.slice(F.array_sort(marked), 1, focus), lambda s: s["t"])
    theme = F.element_at(F.array(*[F.lit(t) for t in themes]), (F.col("request") % len(themes) + 1).cast("int"))
    return rows.select("db_id", "request", theme.alias("theme"), F.array_join(chosen, ", ").alias("focus"))


def token_limit(records: DataFrame, column: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Adds ``tokens`` and whether a trainer would cut the record."""
    return records.withColumn("tokens", token_count(F.col(column))).withColumn("too_long", F.col("tokens") > limit)


def too_long_share(flagged: DataFrame, by: str) -> DataFrame:
    return flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("too_long").alias("too_long"),
        F.round(100 * F.avg(F.col("too_long").cast("double")), 4).alias("share"),
    )
