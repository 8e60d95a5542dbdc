"""Token and latency reports over a call log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.plans import exact_median


def total_tokens(prompt: Column, completion: Column, total: Column | None = None) -> Column:
    """The reported total, or prompt plus completion when it is absent or 0."""
    parts = F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))
    return parts if total is None else F.when(F.coalesce(total, F.lit(0)) == 0, parts).otherwise(total)


def usage_measures(total: Column | None = None) -> list[Column]:
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    return [
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce(prompt, F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce(completion, F.lit(0))).alias("completion_tokens"),
        F.sum(total_tokens(prompt, completion, total)).alias("total_tokens"),
    ]


def usage_totals(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.col("total_tokens") if "total_tokens" in calls.columns else None
    return calls.groupBy(*by).agg(*usage_measures(total))


def token_budget(prompts: DataFrame, by: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Mean, median (cut to whole tokens), population deviation, smallest and largest."""
    spread = prompts.groupBy(*by).agg(
        F.round(F.avg(tokens), 1).alias("mean"),
        F.round(F.stddev_pop(tokens), 1).alias("sd"),
        F.min(tokens).alias("min"),
        F.max(tokens).alias("max"),
    )
    middle = exact_median(prompts, by, tokens).select(*by, "n", F.col("median").cast("bigint").alias("median"))
    return spread.join(middle, list(by))


def mean_by_db(prompts: DataFrame, by: Sequence[str], tokens: str = "tokens") -> DataFrame:
    return prompts.groupBy(*by, "db_id").agg(F.round(F.avg(tokens), 1).alias("mean"))


def latency_summary(calls: DataFrame, by: Sequence[str] = ("arm",), seconds: str = "latency_s") -> DataFrame:
    timed = calls.filter(F.col(seconds).isNotNull())
    means = timed.groupBy(*by).agg(F.round(F.avg(seconds), 2).alias("mean_s"))
    middle = exact_median(timed, by, seconds).select(*by, "n", F.round("median", 2).alias("median_s"))
    return means.join(middle, list(by))


def speedup(summary: DataFrame, baseline: str, arm: str = "arm") -> DataFrame:
    """How many times faster each arm's median is than the baseline's; arms at 0 are skipped."""
    base = summary.filter(F.col(arm) == baseline).agg(F.first("median_s")).scalar()
    return summary.filter((F.col("median_s") != 0) & (F.col(arm) != baseline)).select(
        arm, F.round(base / F.col("median_s"), 4).alias("speedup")
    )


def context_ratio(budget: DataFrame, baseline: str, arm: str = "arm") -> DataFrame:
    """Mean prompt tokens of each arm over those of the baseline arm."""
    base = budget.filter(F.col(arm) == baseline).agg(F.first("mean")).scalar()
    return budget.filter(F.col(arm) != baseline).select(
        arm, F.round(F.col("mean") / F.nullif(base, F.lit(0.0)), 4).alias("ratio")
    )
