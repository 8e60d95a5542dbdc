"""Model calls over partitions, and what is read out of the replies.

The model is a function the caller brings; nothing here knows one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qloom.functions import text
from qloom.plans import cut_lineage

PAIR_LIST = T.ArrayType(
    T.StructType([T.StructField(name, T.StringType()) for name in ("question", "sql", "difficulty")])
)


#: Calls in flight over all tasks of a job.
IN_FLIGHT = 64


def answers_of(pool: ThreadPoolExecutor, ask: Callable[[str], tuple], values: list[str], concurrency: int) -> list[tuple]:
    """Answers in the order of the values. Each thread takes the next open one until none is left: a future
    per value costs more than a quick call."""
    answers: list = [None] * len(values)
    following = count()

    def work(_: int) -> None:
        while (at := next(following)) < len(values):
            answers[at] = ask(values[at])

    list(pool.map(work, range(concurrency)))
    return answers


def batch_generate(
    prompts: DataFrame,
    fn: Callable[[str], str],
    prompt: str = "prompt",
    concurrency: int = 8,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Adds ``reply`` and ``failure``: ``fn`` is called once per prompt. A failed or blank reply is NULL.

    At most ``concurrency`` calls are in flight per task, and ``in_flight`` in all, whatever the number of
    partitions or executors: rows are dealt to as many tasks as the bound has room for. Each task
    streams its rows. A task that Spark runs again asks again.
    """
    if in_flight < 1 or concurrency < 1:
        raise ValueError("at least one call must be in flight")
    concurrency = min(concurrency, in_flight)
    # Explicit numbers of partitions are kept by adaptive execution.
    spread = F.xxhash64(*[c for c in prompts.columns if prompts.schema[c].dataType.typeName() not in ("map", "variant")])
    prompts = prompts.repartition(in_flight // concurrency, spread)
    schema = T.StructType(
        [*prompts.schema.fields, T.StructField("reply", T.StringType()), T.StructField("failure", T.StringType())]
    )

    def ask(value: str) -> tuple[str | None, str | None]:
        try:
            reply = (fn(value) or "").strip()
        except Exception as exc:
            return None, f"{type(exc).__name__}: {exc}"[:80]
        return (reply, None) if reply else (None, "empty reply")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                answers = answers_of(pool, ask, list(batch[prompt]), concurrency)
                yield batch.assign(reply=[a[0] for a in answers], failure=[a[1] for a in answers])

    return prompts.mapInPandas(run, schema)


def check_ambiguity(reply: Column) -> Column:
    return text.verdict(reply, "clear", "ambiguous")


def check_statement(reply: Column) -> Column:
    return text.verdict(reply, "correct", "incorrect")


def retry_until_valid(
    prompts: DataFrame,
    fn: Callable[[str], str],
    prompt: str = "prompt",
    validator: Callable[[Column], Column] = text.is_valid,
    sanitize: bool = False,
    max_attempts: int = 7,
    concurrency: int = 8,
    ask_again: Callable[[Column, int], Column] = lambda value, attempt: value,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """Adds ``sql``, ``attempts`` and ``status``: rows whose statement is not valid
    are asked again, up to ``max_attempts`` times, then marked ``error``.
    ``ask_again`` may reword the prompt for a given attempt.

    Every round is checkpointed, so a lost executor does not repeat its calls,
    and only the rows still open enter the next one.
    """
    columns = prompts.columns
    open_rows, finished = prompts, None
    for attempt in range(1, max_attempts + 1):
        worded = open_rows.withColumn("__prompt", ask_again(F.col(prompt), attempt))
        asked = batch_generate(worded, fn, "__prompt", concurrency, in_flight).drop("__prompt")
        reply = text.sanitize_sql(F.col("reply")) if sanitize else text.strip(F.col("reply"))
        cleaned = asked.withColumn("sql", text.strip_comments(reply))
        judged = cut_lineage(cleaned.withColumn("__ok", F.coalesce(validator(F.col("sql")), F.lit(False))))
        done = judged.filter("__ok").select(
            *columns, "sql", F.lit(attempt).alias("attempts"), F.lit("success").alias("status")
        )
        finished = done if finished is None else finished.unionByName(done)
        open_rows = judged.filter(~F.col("__ok")).select(*columns)
        if open_rows.isEmpty():
            return finished
    given_up = open_rows.select(
        "*",
        F.lit(None).cast("string").alias("sql"),
        F.lit(max_attempts).alias("attempts"),
        F.lit("error").alias("status"),
    )
    return finished.unionByName(given_up)


@F.pandas_udf(PAIR_LIST)
def _first_json_array(replies: pd.Series) -> pd.Series:
    """Objects of the first well-formed JSON array; it may sit anywhere in the text."""
    decoder = json.JSONDecoder()

    def as_text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def parse(reply: str | None) -> list[dict] | None:
        at = -1 if reply is None else reply.find("[")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(reply, at)
            except json.JSONDecodeError:
                at = reply.find("[", at + 1)
                continue
            found = [item for item in value if isinstance(item, dict) and item.get("question") and item.get("sql")]
            return [{k: as_text(item.get(k)) for k in ("question", "sql", "difficulty")} for item in found]
        return None

    return replies.map(parse)


def parse_pair_batch(replies: DataFrame, column: str = "reply") -> DataFrame:
    """One row per question/SQL object in each reply's first JSON array.

    A reply with exactly one bracket pair is parsed in the JVM; only the others,
    and those the JVM refuses, are handed to Python.
    """
    reply = F.col(column)
    single = (F.regexp_count(reply, F.lit(r"\[")) == 1) & (F.regexp_count(reply, F.lit(r"\]")) == 1)
    fast = F.from_json(F.when(single, F.regexp_extract(reply, r"(?s)\[.*\]", 0)), PAIR_LIST)
    parsed = replies.withColumn("__fast", fast)
    parsed = parsed.withColumn("__slow", _first_json_array(F.when(F.col("__fast").isNull() & reply.contains("["), reply)))
    items = F.filter(
        F.coalesce("__fast", "__slow"),
        lambda p: (F.coalesce(p["question"], F.lit("")) != "") & (F.coalesce(p["sql"], F.lit("")) != ""),
    )
    return parsed.select(*replies.columns, F.inline(items))
