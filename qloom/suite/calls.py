"""Usage reports and model calls."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from qloom.functions.tokens import token_count, token_count_with
from qloom.operators import generate, tasks, usage
from qloom.streaming import usage as streaming
from qloom.suite import fixtures
from qloom.suite.registry import query, table
from qloom.suite.training import DB_LINE, TOKENS

C = ("f_calls",)

TOTALS = """
SELECT arm, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(CASE WHEN coalesce(total_tokens, 0) = 0 THEN prompt_tokens + completion_tokens ELSE total_tokens END) AS BIGINT)
         AS total_tokens
FROM (SELECT *, CASE call_id % 3 WHEN 0 THEN 0 WHEN 1 THEN prompt_tokens + completion_tokens + 1 END AS total_tokens FROM f_calls)
GROUP BY arm"""
TOTAL = "CASE call_id % 3 WHEN 0 THEN 0 WHEN 1 THEN prompt_tokens + completion_tokens + 1 END"


@query("t1_usage_totals", TOTALS, C)
def usage_totals(spark, sf_dir):
    calls = fixtures.calls(spark, sf_dir).withColumn("total_tokens", F.expr(TOTAL))
    return usage.usage_totals(calls, ["arm"])


@query("t2_token_count", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(
    "t2_token_count_with",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \n\t\r\f\v]+')) AS BIGINT) AS tokens FROM documents",
)
def count_tokens_with(spark, sf_dir):
    def load():
        import re

        return re.compile(r"[^ \n\t\r\f\v]+").findall

    return table(spark, sf_dir, "documents").select("doc_id", token_count_with(load)(F.col("text")).alias("tokens"))


@query(
    "t3_token_budget",
    """SELECT arm, count(*) AS n, round(avg(prompt_tokens), 1) AS mean, CAST(floor(median(prompt_tokens)) AS BIGINT) AS median,
round(stddev_pop(prompt_tokens), 1) AS sd, min(prompt_tokens) AS min, max(prompt_tokens) AS max FROM f_calls GROUP BY arm""",
    C,
)
def token_budget(spark, sf_dir):
    return usage.token_budget(fixtures.calls(spark, sf_dir), ["arm"], "prompt_tokens")


@query(
    "t3_prompt_tokens_by_db",
    rf"""WITH p AS (SELECT db_id, {DB_LINE}Answer with one SQL statement.' || 'Question: ' || question ||
  E'\nHint: ' AS text FROM f_eval)
SELECT 'without schema' AS arm, db_id, round(avg({TOKENS}), 1) AS mean FROM p GROUP BY db_id""",
    ("f_eval",),
)
def prompt_tokens_by_db(spark, sf_dir):
    prompts = tasks.build_prompts(fixtures.eval_set(spark, sf_dir)).select(
        F.lit("without schema").alias("arm"), "db_id", token_count(F.concat("system", "user")).alias("tokens")
    )
    return usage.mean_by_db(prompts, ["arm"])


@query(
    "t4_latency_summary",
    """SELECT arm, count(latency_s) AS n, round(avg(latency_s), 2) AS mean_s, round(median(latency_s), 2) AS median_s
FROM f_calls WHERE latency_s IS NOT NULL GROUP BY arm""",
    C,
)
def latency_summary(spark, sf_dir):
    return usage.latency_summary(fixtures.calls(spark, sf_dir))


@query(
    "t4_speedup",
    """WITH m AS (SELECT arm, round(median(latency_s), 2) AS median_s FROM f_calls WHERE latency_s IS NOT NULL GROUP BY arm)
SELECT m.arm, round(b.median_s / m.median_s, 4) AS speedup FROM m, m b
WHERE b.arm = 'click' AND m.arm <> 'click' AND m.median_s <> 0""",
    C,
)
def speedup(spark, sf_dir):
    return usage.speedup(usage.latency_summary(fixtures.calls(spark, sf_dir)), "click")


def shared_folder(spark) -> str:
    """A fresh folder under the cluster's checkpoint folder; local runs use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="qloom-stream-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query("t5_usage_stream", TOTALS, C)
def usage_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # A pattern matches the table whether it is one file or a folder of parts.
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    calls = source.selectExpr(
        "event_id AS call_id", "event_type AS arm", "50 + (event_id % 200) AS prompt_tokens",
        "5 + (user_id % 60) AS completion_tokens",
    ).withColumn("total_tokens", F.expr(TOTAL))
    folder = shared_folder(spark)
    started = streaming.start_usage_totals(streaming.usage_stream(calls), f"{folder}/totals", f"{folder}/checkpoint")
    started.awaitTermination()
    return streaming.read_usage_totals(spark, f"{folder}/totals")


@query(
    "t6_context_ratio",
    """WITH m AS (SELECT arm, round(avg(prompt_tokens), 1) AS mean FROM f_calls GROUP BY arm)
SELECT m.arm, round(m.mean / b.mean, 4) AS ratio FROM m, m b WHERE b.arm = 'click' AND m.arm <> 'click'""",
    C,
)
def context_ratio(spark, sf_dir):
    budget = usage.token_budget(fixtures.calls(spark, sf_dir), ["arm"], "prompt_tokens")
    return usage.context_ratio(budget, "click")


def stub_model(prompt: str) -> str:
    """Stands in for a model: upper case, an error and a blank reply now and then."""
    if prompt.endswith("7"):
        raise TimeoutError("no answer")
    return " " if prompt.endswith("3") else prompt.upper()


@query(
    "u1_batch_generate",
    """SELECT question_id, CASE WHEN right(question, 1) IN ('3', '7') THEN NULL ELSE upper(question) END AS reply,
CASE right(question, 1) WHEN '7' THEN 'TimeoutError: no answer' WHEN '3' THEN 'empty reply' END AS failure FROM f_eval""",
    ("f_eval",),
)
def batch_generate(spark, sf_dir):
    prompts = fixtures.eval_set(spark, sf_dir).select("question_id", F.col("question").alias("prompt"))
    return generate.batch_generate(prompts, stub_model).drop("prompt")


JUDGEMENT = (
    "CASE pair_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN ' ok ' WHEN 2 THEN concat('Which year? ', question) ELSE NULL END"
)


@query(
    "u2_verdict",
    f"""WITH t AS (SELECT pair_id, {JUDGEMENT} AS reply FROM f_pairs),
v AS (SELECT pair_id, CASE WHEN reply IS NULL THEN 'error' WHEN lower(trim(reply)) = 'ok' THEN 'good' ELSE 'bad' END AS s,
      trim(reply) AS r FROM t)
SELECT pair_id, CASE s WHEN 'good' THEN 'clear' WHEN 'bad' THEN 'ambiguous' ELSE s END AS ambiguity,
  CASE s WHEN 'good' THEN 'correct' WHEN 'bad' THEN 'incorrect' ELSE s END AS correctness,
  CASE s WHEN 'bad' THEN r END AS reason FROM v""",
    ("f_pairs",),
)
def verdict(spark, sf_dir):
    replies = fixtures.pairs(spark, sf_dir).selectExpr("pair_id", f"{JUDGEMENT} AS reply")
    unclear = generate.check_ambiguity(F.col("reply"))
    return replies.select(
        "pair_id",
        unclear["status"].alias("ambiguity"),
        generate.check_statement(F.col("reply"))["status"].alias("correctness"),
        unclear["reason"].alias("reason"),
    )


def stub_writer(prompt: str) -> str:
    """Gets it right at the attempt the customer number asks for; never when it ends in 9."""
    number, attempt = prompt.split("#")
    if int(number[-1]) > int(attempt):
        return "I would SELECT something"
    return f"```sql\nSELECT o_totalprice FROM orders WHERE o_custkey = {number}\n```"


@query(
    "u3_retry_until_valid",
    """WITH t AS (SELECT question_id, CAST(regexp_extract(question, '\\d+$') AS VARCHAR) AS number FROM f_eval)
SELECT question_id, CASE WHEN CAST(right(number, 1) AS INT) <= 7
   THEN 'SELECT o_totalprice FROM orders WHERE o_custkey = ' || number END AS sql,
  least(7, greatest(1, CAST(right(number, 1) AS INT))) AS attempts,
  CASE WHEN CAST(right(number, 1) AS INT) <= 7 THEN 'success' ELSE 'error' END AS status FROM t""",
    ("f_eval",),
)
def retry_until_valid(spark, sf_dir):
    prompts = fixtures.eval_set(spark, sf_dir).select(
        "question_id", F.regexp_extract("question", r"\d+$", 0).alias("prompt")
    )
    answered = generate.retry_until_valid(
        prompts, stub_writer, ask_again=lambda value, attempt: F.concat(value, F.lit(f"#{attempt}"))
    )
    return answered.drop("prompt")
