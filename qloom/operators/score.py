"""Accuracy, efficiency and comparison reports over scored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qloom.functions import text
from qloom.operators.outcomes import AMBIGUOUS
from qloom.plans import lookup_join, order_statistics

DIFFICULTIES = ("simple", "moderate", "challenging")  # fixed values


def exec_ratio(score: Column, t_gold: Column, t_pred: Column) -> Column:
    """How fast a correct prediction is next to gold; 0 when wrong or untimed."""
    return F.when((score == 1) & (t_pred > 0), F.sqrt(t_gold / t_pred)).otherwise(F.lit(0.0))


def _ex(score: str = "score") -> Column:
    return F.coalesce(100 * F.avg(F.col(score).cast("double")), F.lit(0.0))


def _ves(ratio: str = "exec_ratio") -> Column:
    return F.coalesce(100 * F.avg(ratio), F.lit(0.0))


def with_ratio(scored: DataFrame) -> DataFrame:
    return scored.withColumn("exec_ratio", exec_ratio(F.col("score"), F.col("t_gold"), F.col("t_pred")))


def _levels(scored: DataFrame, by: str, name: str, measure: Column) -> DataFrame:
    """Overall and per value of ``by`` in one pass; without rows the overall is 0."""
    levels = scored.rollup(by).agg(
        F.when(F.grouping(by) == 1, "overall").otherwise(by).alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.round(measure, 6).alias(name),
    )
    nothing = scored.sparkSession.range(1).select(
        F.lit(None).cast("string").alias(by), F.lit("overall").alias("level"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias(name)
    )
    return levels.unionByName(nothing).groupBy(by, "level").agg(F.max("n").alias("n"), F.max(name).alias(name))


def execution_accuracy(scored: DataFrame, by: str = "difficulty") -> DataFrame:
    return _levels(scored, by, "ex", _ex())


def efficiency_score(scored: DataFrame, by: str = "difficulty") -> DataFrame:
    return _levels(with_ratio(scored), by, "ves", _ves())


def upper_median_time(samples: DataFrame, by: Sequence[str], seconds: str) -> DataFrame:
    """Element n // 2 of the sorted times, so the upper median for even n."""
    stats = order_statistics(samples, by, seconds, {"upper_median": lambda n: F.floor(n / 2) + 1})
    return stats.select(*by, "n", F.col("value").alias("upper_median"))


def ambiguous_rate(scored: DataFrame) -> DataFrame:
    """Share of "ambiguous" predictions, and of those that are wrong to say so."""
    said = F.col("predicted_sql") == AMBIGUOUS
    wrongly = said & (F.col("gold_sql") != AMBIGUOUS)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(said).alias("ambiguous"),
        F.round(F.coalesce(100 * F.avg(said.cast("double")), F.lit(0.0)), 6).alias("ambiguous_rate"),
        F.round(F.coalesce(100 * F.avg(wrongly.cast("double")), F.lit(0.0)), 6).alias("false_ambiguous_rate"),
    )


def ambiguity_confusion(scored: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Accuracy and counts of a yes/no judgement, given as two boolean columns."""
    return scored.select(gold.alias("g"), predicted.alias("p")).agg(
        F.round(F.coalesce(100 * F.avg((F.col("g") == F.col("p")).cast("double")), F.lit(0.0)), 6).alias("accuracy"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("g").alias("gold_ambiguous"),
        F.count_if("p").alias("pred_ambiguous"),
        F.count_if(F.col("g") & F.col("p")).alias("true_positive"),
    )


def score_by_db(scored: DataFrame, questions: DataFrame, seeds: int) -> DataFrame:
    """Pooled over seeds: question count per seed, EX and VES per database and in
    total; questions without a database go under ``?``."""
    pooled = lookup_join(with_ratio(scored).drop("db_id"), questions.select("question_id", "db_id"), ["question_id"])
    pooled = pooled.withColumn("db_id", F.coalesce("db_id", F.lit("?")))
    return (
        pooled.rollup("db_id")
        .agg(
            F.grouping("db_id").alias("__all"),
            F.floor(F.count(F.lit(1)) / F.lit(max(1, seeds))).cast("bigint").alias("n"),
            F.round(_ex(), 6).alias("ex"),
            F.round(_ves(), 6).alias("ves"),
        )
        .select(F.when(F.col("__all") == 1, F.lit("total")).otherwise(F.col("db_id")).alias("db_id"), "n", "ex", "ves")
    )


def _seed_scores(scored: DataFrame) -> DataFrame:
    return with_ratio(scored).groupBy("arm", "seed").agg(_ex().alias("ex"), _ves().alias("ves"))


def leaderboard(scored: DataFrame, expected_seeds: int | DataFrame) -> DataFrame:
    """Mean and population deviation of EX and VES over seeds; arms with a seed
    missing are left out. ``expected_seeds`` is one number for all arms, or a frame of arms:
    (arm, expected_seeds) and whatever else describes an arm, which is kept."""
    by_seed = _seed_scores(scored)
    values = F.transform(
        F.array_sort(F.collect_list(F.struct("seed", "ex"))), lambda s: F.format_string("%.2f", s["ex"])
    )
    board = (
        by_seed.groupBy("arm")
        .agg(
            F.count(F.lit(1)).alias("seeds"),
            F.round(F.avg("ex"), 6).alias("ex_mean"),
            F.round(F.stddev_pop("ex"), 6).alias("ex_sigma"),
            F.round(F.avg("ves"), 6).alias("ves_mean"),
            F.round(F.stddev_pop("ves"), 6).alias("ves_sigma"),
            F.concat_ws(" / ", values).alias("ex_all"),
        )
    )
    if isinstance(expected_seeds, int):
        return board.filter(F.col("seeds") == expected_seeds)
    return board.join(expected_seeds, "arm").filter(F.col("seeds") == F.col("expected_seeds")).drop("expected_seeds")


def first_seed_difficulty(scored: DataFrame) -> DataFrame:
    """EX by difficulty, from each arm's first seed only."""
    first = scored.groupBy("arm").agg(F.min("seed").alias("seed"))
    return (
        lookup_join(scored, first.withColumn("first", F.lit(True)), ["arm", "seed"], "left_semi")
        .groupBy("arm", "difficulty")
        .agg(F.round(_ex(), 2).alias("ex"))
    )


def plus_minus(mean: Column, sigma: Column, seeds: Column) -> Column:
    """``mean ± σ``, or the plain mean for a single seed."""
    return F.when(seeds > 1, F.format_string("%.2f ± %.2f", mean, sigma)).otherwise(F.format_string("%.2f", mean))


def leaderboard_table(board: DataFrame, group: Column, titles: dict[str, str]) -> DataFrame:
    """Printable board: a titled group per row, EX and VES as text."""
    title = F.lit(None).cast("string")
    for key, label in titles.items():
        title = F.when(group == key, F.lit(label)).otherwise(title)
    return board.select(
        title.alias("title"),
        "arm",
        plus_minus(F.col("ex_mean"), F.col("ex_sigma"), F.col("seeds")).alias("ex"),
        plus_minus(F.col("ves_mean"), F.col("ves_sigma"), F.col("seeds")).alias("ves"),
        "seeds",
    ).orderBy("title", "arm")


def difficulty_pivot(scored: DataFrame) -> DataFrame:
    return scored.groupBy("arm").pivot("difficulty", list(DIFFICULTIES)).agg(F.round(_ex(), 6))


def gap_in_sigma(board: DataFrame, baseline: str) -> DataFrame:
    """How far each arm is from a baseline arm: difference of means in points and
    in the arm's own deviation."""
    base = board.filter(F.col("arm") == baseline).agg(F.first("ex_mean")).scalar()
    gap = F.col("ex_mean") - base
    return board.filter(F.col("arm") != baseline).select(
        "arm",
        F.round(gap, 6).alias("gap"),
        F.round(gap / F.nullif("ex_sigma", F.lit(0.0)), 4).alias("gap_in_sigma"),
    )


def leak_corrected_scores(scored: DataFrame, leaked: DataFrame) -> DataFrame:
    """EX per arm with and without the contaminated question ids."""
    hits = leaked.select("question_id").distinct().withColumn("hit", F.lit(1))
    marked = lookup_join(scored, hits, ["question_id"], hashed=True)
    clean = F.col("hit").isNull()
    return marked.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(clean).alias("n_clean"),
        F.round(_ex(), 6).alias("ex"),
        F.round(F.coalesce(100 * F.avg(F.when(clean, F.col("score").cast("double"))), F.lit(0.0)), 6).alias("ex_clean"),
    )


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two prediction sets side by side, (question_id, sql) each."""
    left = a.select("question_id", F.coalesce("sql", F.lit("")).alias("sql_a"), F.lit(True).alias("in_a"))
    right = b.select("question_id", F.coalesce("sql", F.lit("")).alias("sql_b"), F.lit(True).alias("in_b"))
    both = F.col("in_a") & F.col("in_b")
    return left.join(right, "question_id", "full_outer").withColumns(
        {
            "common": F.coalesce(both, F.lit(False)),
            "differs": F.coalesce(both & (text.comparable(F.col("sql_a")) != text.comparable(F.col("sql_b"))), F.lit(False)),
        }
    )


def compare_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts: common ids, same text, different text, ids on one side only."""
    return paired(a, b).agg(
        F.count_if("common").alias("common"),
        F.count_if(F.col("common") & ~F.col("differs")).alias("same"),
        F.count_if("differs").alias("different"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
    )


def differences_by_db(a: DataFrame, b: DataFrame, questions: DataFrame) -> DataFrame:
    """Differences per database; unknown ids under ``?``."""
    differing = paired(a, b).filter("differs")
    return (
        lookup_join(differing, questions.select("question_id", "db_id"), ["question_id"])
        .groupBy(F.coalesce("db_id", F.lit("?")).alias("db_id"))
        .agg(F.count(F.lit(1)).alias("different"))
    )


def first_differences(a: DataFrame, b: DataFrame, k: int = 10, width: int = 180) -> DataFrame:
    """The first ``k`` differing questions by numeric id."""
    shown = [F.substring(text.strip(F.col(c)), 1, width).alias(c) for c in ("sql_a", "sql_b")]
    return (
        paired(a, b)
        .filter("differs")
        .orderBy(F.col("question_id").cast("bigint"))
        .limit(k)
        .select("question_id", *shown)
    )


def coverage_check(predictions: DataFrame, gold: DataFrame, by: str = "arm") -> DataFrame:
    """Per arm: gold ids without a prediction, predicted ids unknown to gold."""
    ids = predictions.select(by, "question_id").distinct()
    known = gold.select("question_id").distinct()
    n_gold = known.agg(F.count(F.lit(1))).scalar()
    marked = lookup_join(ids, known.withColumn("known", F.lit(1)), ["question_id"])
    return marked.groupBy(by).agg(
        (n_gold - F.count("known")).alias("missing"), F.count_if(F.col("known").isNull()).alias("extra")
    )


def dead_gold_share(gold_outcomes: DataFrame, failed: Column) -> DataFrame:
    """Share of gold statements that do not run: a ceiling for every arm."""
    return gold_outcomes.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("dead"),
        F.round(100 * F.avg(failed.cast("double")), 6).alias("dead_share"),
        F.round(100 - 100 * F.avg(failed.cast("double")), 6).alias("ceiling"),
    )


def rescore_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change per arm between two measurements, in points and in questions."""
    before = old.groupBy("arm").agg(_ex().alias("old_ex"))
    after = new.groupBy("arm").agg(_ex().alias("new_ex"), F.count(F.lit(1)).alias("n"))
    delta = F.col("new_ex") - F.col("old_ex")
    return before.join(after, "arm").select(
        "arm",
        F.round("old_ex", 6).alias("old_ex"),
        F.round("new_ex", 6).alias("new_ex"),
        F.round(delta, 6).alias("delta"),
        F.bround(F.round(delta * F.col("n") / 100, 6), 0).cast("bigint").alias("delta_questions"),
    )


def learning_curve(board: DataFrame, size: Column) -> DataFrame:
    """EX against training size with the gain over the size before. One row per
    arm enters, so the un-partitioned order is over a handful of rows."""
    steps = board.withColumn("size", size)
    order = Window.partitionBy(F.lit(0)).orderBy("size")
    return steps.select(
        "size", F.round("ex_mean", 6).alias("ex"), F.round(F.col("ex_mean") - F.lag("ex_mean").over(order), 6).alias("gain")
    )
