"""Filtering, duplicate and leak removal, splits and manifests of pair corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.functions import text
from qloom.plans import (
    HOT_ROWS,
    cut_lineage,
    first_by_hash,
    hash_cutoffs,
    hash_key,
    hot_keys,
    lookup_join,
    most_rows,
    row_sample,
)
from qloom.sources.records import table_version

KEPT = "kept"
UNPARSABLE = "unparsable"
TRIVIAL = "trivial"
DUPLICATE = "duplicate"
FAILS = "fails to run"
EMPTY = "empty"

PAIR_DEFAULTS = {"difficulty": "unknown"}


def filter_pairs(pairs: DataFrame, position: str = "pair_id") -> DataFrame:
    """Adds the normalised ``sql`` and the ``reason`` a pair is kept or rejected.

    Outcomes come in as parse_ok, exec_ok and row_count. A duplicate is a repeat
    of a pair already kept; repeats in front of the first kept one are judged on
    their own. The first kept position per text is aggregated map-side, and rows
    find it through a lookup that splits a text shared by very many rows.
    """
    judged = pairs.withColumn("sql", text.normalize_sql(F.col("sql"))).withColumns(
        {
            # 128 bits instead of the text cross the shuffle.
            "__fp": F.md5(text.fingerprint(F.col("sql"))),
            "__trivial": text.is_trivial(F.col("sql")),
        }
    )
    # What is not known to have been parsed or run has not.
    parsed = F.coalesce("parse_ok", F.lit(False))
    ran = F.coalesce("exec_ok", F.lit(False)) & F.col("row_count").isNotNull()
    sound = parsed & ~F.col("__trivial") & ran & (F.col("row_count") > 0)
    texts = judged.groupBy("__fp").agg(
        F.min(F.when(sound, F.col(position))).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    # The counts tell which texts are shared by too many rows for one task.
    hot = most_rows(texts, ["__fp"], "__n", HOT_ROWS)
    placed = lookup_join(judged, texts.drop("__n"), ["__fp"], hot=hot)
    reason = (
        F.when(~parsed, UNPARSABLE)
        .when(F.col("__trivial"), TRIVIAL)
        .when(F.col("__first") < F.col(position), DUPLICATE)
        .when(~ran, FAILS)
        .when(F.col("row_count") == 0, EMPTY)
        .otherwise(KEPT)
    )
    return placed.withColumn("reason", reason).drop("__fp", "__trivial", "__first")


def reject_report(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs per reason with their share of all pairs (of each ``by`` group)."""
    counts = judged.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, list(by)) if by else counts.withColumn("total", totals.select("total").scalar())
    return joined.select(*by, "reason", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("share"))


def kept_by_difficulty(judged: DataFrame) -> DataFrame:
    return (
        judged.filter(F.col("reason") == KEPT)
        .groupBy(F.coalesce("difficulty", F.lit(PAIR_DEFAULTS["difficulty"])).alias("difficulty"))
        .agg(F.count(F.lit(1)).alias("kept"))
    )


def error_class(message: Column) -> Column:
    """Driver error class named in a message, ``other`` when none is."""
    name = F.regexp_extract(message, r"errors\.(\w+)", 1)
    return F.when(name != "", name).otherwise(F.lit("other"))


def error_taxonomy(failures: DataFrame, message: str = "error") -> DataFrame:
    return (
        failures.filter(F.col(message).isNotNull())
        .groupBy(error_class(F.col(message)).alias("error_class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _leak_hash(sql: str) -> Column:
    return F.md5(text.leak_key(F.col(sql)))


def eval_keys(eval_set: DataFrame, sql: str = "gold_sql") -> DataFrame:
    """(db_id, key, question_id): of questions that share a key the later one owns it."""
    return (
        eval_set.select("db_id", _leak_hash(sql).alias("__key"), "question_id")
        .groupBy("db_id", "__key")
        .agg(F.max("question_id").alias("question_id"))
    )


def _against(train: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__key", _leak_hash("sql"))

    on = ["db_id", "__key"]
    # The join reads the keys twice, and filters on them would compute each again.
    keys = cut_lineage(keys)
    # Sampling comes before the key is computed, so only sampled rows pay for it.
    hot = hot_keys(keyed(row_sample(train.select("db_id", "sql"))), on)
    return lookup_join(keyed(train), keys, on, how, hot, hashed=True).drop("__key")


def mark_leaks(train: DataFrame, eval_set: DataFrame, flag: str = "leaks") -> DataFrame:
    """Training rows with whether each leaks: ``find_leaks`` and ``drop_leaks`` in one reading."""
    keys = eval_keys(eval_set).select("db_id", "__key", F.lit(True).alias(flag))
    return _against(train, keys, "left").withColumn(flag, F.col(flag).isNotNull())


def find_leaks(train: DataFrame, eval_set: DataFrame) -> DataFrame:
    """Training rows whose statement is an evaluation answer of the same database."""
    return _against(train, eval_keys(eval_set), "inner")


def drop_leaks(train: DataFrame, eval_set: DataFrame) -> DataFrame:
    """Training rows without the leaking ones; databases outside the evaluation
    file stay whole."""
    return _against(train, eval_keys(eval_set).drop("question_id"), "left_anti")


def leak_report(train: DataFrame, eval_set: DataFrame) -> DataFrame:
    """(question_id, pair_id, train_question): every training pair that hits a contaminated question."""
    leaks = find_leaks(train.select("pair_id", "db_id", "question", "sql"), eval_set)
    return leaks.select("question_id", "pair_id", F.col("question").alias("train_question"))


def leak_counts(train: DataFrame, eval_set: DataFrame) -> DataFrame:
    """(question_id, train_hits): how many training pairs hit each contaminated question."""
    leaks = find_leaks(train.select("pair_id", "db_id", "sql"), eval_set)
    return leaks.groupBy("question_id").agg(F.count(F.lit(1)).alias("train_hits"))


def leak_totals(train: DataFrame, eval_set: DataFrame) -> DataFrame:
    """One row: sizes, contaminated questions, leaking pairs and whether the gate passes."""
    leaks = find_leaks(train.select("pair_id", "db_id", "sql"), eval_set)
    hit = leaks.agg(F.count_distinct("question_id").alias("contaminated"), F.count(F.lit(1)).alias("leaking_pairs"))
    return hit.select(
        eval_set.agg(F.count(F.lit(1))).scalar().alias("eval_questions"),
        train.agg(F.count(F.lit(1))).scalar().alias("train_pairs"),
        "contaminated",
        "leaking_pairs",
        (F.col("contaminated") == 0).alias("passed"),
    )


def stratified_split(pairs: DataFrame, fraction: float = 0.15, seed: object = 0, key: str = "pair_id") -> DataFrame:
    """Adds ``split``: per database the first ``max(1, round(n * fraction))`` rows
    in hash order are validation, the rest training. Rounds half to even."""
    sized = first_by_hash(
        pairs, ["db_id"], key, lambda n: F.greatest(F.lit(1), F.bround(n * fraction, 0)), seed, flag="__val"
    )
    return sized.withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def nested_sizes(pairs: DataFrame, sizes: Sequence[int], seed: object = 0, key: str = "pair_id") -> DataFrame:
    """One row per variant and pair; smaller variants are subsets of larger ones.
    All variants are prefixes of a single hash order."""
    cutoffs = hash_cutoffs(pairs, [], key, {str(s): (lambda n, s=s: F.lit(s)) for s in sizes}, seed)
    # One row per requested size; rows past the largest variant go before they multiply.
    cut = cutoffs.agg(F.collect_list(F.struct("label", "cutoff")).alias("cut"), F.max("cutoff").alias("last"))
    hashed = pairs.withColumn("__h", hash_key(seed, F.col(key)))
    within = hashed.filter(F.col("__h") <= cut.select("last").scalar()).withColumn("__cut", cut.select("cut").scalar())
    return (
        within.select(*pairs.columns, "__h", F.inline("__cut"))
        .filter(F.col("__h") <= F.col("cutoff"))
        .select(*pairs.columns, F.col("label").cast("bigint").alias("variant"))
    )


def manifest(
    train: DataFrame, val: DataFrame, leaks_removed: int | Column, sources: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Tidy counts (section, name, n): databases and difficulties over all rows,
    tasks over training rows, totals of both parts and the leaks removed. Each of ``sources`` gives
    a row with its name, the version of its content (``table_version``), and its number of rows."""
    columns = ["db_id", "difficulty", "task"]
    rows = (
        train.select(*columns, F.lit("train").alias("part"))
        .unionByName(val.select(*columns, F.lit("val").alias("part")))
        .withColumn("difficulty", F.coalesce("difficulty", F.lit(PAIR_DEFAULTS["difficulty"])))
    )
    # One row per combination leaves the map side; kept, so that no section counts the rows again.
    cube = cut_lineage(rows.groupBy("part", *columns).agg(F.count(F.lit(1)).alias("n")))

    def section(label: str, name: Column, keep: Column) -> DataFrame:
        return (
            cube.filter(keep).groupBy(name.alias("name")).agg(F.sum("n").alias("n")).select(F.lit(label).alias("section"), "name", "n")
        )

    every = F.lit(True)
    leaks = leaks_removed if isinstance(leaks_removed, Column) else F.lit(leaks_removed)
    removed = train.sparkSession.range(1).select(
        F.lit("total").alias("section"), F.lit("eval_leaks_removed").alias("name"), leaks.cast("bigint").alias("n")
    )
    def versioned(source: tuple[str, DataFrame]) -> DataFrame:
        name, df = source
        shown = F.concat(F.lit(f"{name} "), "version")
        return table_version(df).select(F.lit("source").alias("section"), shown.alias("name"), F.col("rows").alias("n"))

    return (
        section("by_db", F.col("db_id"), every)
        .unionByName(section("by_difficulty", F.col("difficulty"), every))
        .unionByName(section("by_task", F.col("task"), F.col("part") == "train"))
        .unionByName(section("total", F.concat(F.lit("n_"), F.col("part")), every))
        .unionByName(removed)
        .unionByName(reduce(DataFrame.unionByName, [removed.limit(0), *map(versioned, (sources or {}).items())]))
    )


def tag_source(pairs: DataFrame, source: str, task: str = "sql_generation") -> DataFrame:
    """Training record columns with their defaults."""
    return pairs.withColumns(
        {
            "difficulty": F.coalesce("difficulty", F.lit(PAIR_DEFAULTS["difficulty"])),
            "source": F.lit(source),
            "task": F.lit(task),
        }
    )


def filter_databases(rows: DataFrame, db_ids: Sequence[str] | DataFrame) -> DataFrame:
    """Restrict to target databases, given as names or as a frame of db_id."""
    if isinstance(db_ids, DataFrame):
        return rows.join(db_ids.select("db_id").distinct(), "db_id", "left_semi")
    return rows.filter(F.col("db_id").isin(*db_ids))


def complete_records(rows: DataFrame, defaults: Mapping[str, str] = PAIR_DEFAULTS) -> DataFrame:
    return rows.fillna(dict(defaults))
