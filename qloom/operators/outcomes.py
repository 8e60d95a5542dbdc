"""Running statements, comparing result sets and giving each question its score."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qloom.functions import text
from qloom.plans import local_frame

AMBIGUOUS = "ambiguous"
ERROR = "error"
TIMEOUT = "timeout"

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("statement_id", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("row_count", T.LongType()),
        T.StructField("columns", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


TIMES_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("side", T.StringType(), False),
        T.StructField("run", T.IntegerType(), False),
        T.StructField("seconds", T.DoubleType()),
    ]
)
#: Statements the driver holds at a time.
BLOCK = 1000

Statements = DataFrame | Iterable[tuple[str, str]]


def guard(statements: DataFrame, complete: bool = True) -> DataFrame:
    """Adds ``ok``: whether a statement may run at all. It must be read-only, and complete if asked for."""
    allowed = text.is_valid if complete else text.is_read_only
    return statements.withColumn("ok", F.coalesce(allowed(F.col("sql")), F.lit(False)))


def _kept(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that grows by blocks; empty before the first one."""
    local_frame(spark, [], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _blocks(frame: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The rows in blocks, each a partition of its own, so the driver holds one or two of them."""
    parts = -(-frame.count() // size)
    rows = iter(frame.repartition(parts, frame.columns[0]).toLocalIterator()) if parts else iter(())
    while block := list(islice(rows, size)):
        yield [tuple(r) for r in block]


def _run_one(
    spark: SparkSession, statement_id: str, sql: str, timeout_seconds: float | None, empty_is_error: bool, archive: str | None
) -> tuple:
    context = spark.sparkContext
    tag = f"qloom-{statement_id}"
    timed_out = threading.Event()

    def expire() -> None:
        timed_out.set()
        context.cancelJobsWithTag(tag)

    timer = None if timeout_seconds is None else threading.Timer(timeout_seconds, expire)
    context.addJobTag(tag)
    if timer is not None:
        timer.start()
    try:
        # Every column is computed: a bare count would let the optimizer drop the select list.
        frame = spark.sql(sql)
        counted = Observation()
        cells = [f"c{i}" for i in range(len(frame.columns))]
        whole = frame.toDF(*cells).observe(counted, F.count(F.lit(1)).alias("n"))
        if archive is None:
            whole.write.format("noop").mode("overwrite").save()
        else:
            whole.select(canonical_row(whole)).write.mode("overwrite").parquet(f"{archive}/statement={statement_id}")
        n = counted.get["n"]
    except Exception as exc:
        reason = TIMEOUT if timed_out.is_set() else (str(exc).splitlines() or [type(exc).__name__])[0][:150]
        return statement_id, ERROR, None, None, reason
    finally:
        if timer is not None:
            timer.cancel()
        context.removeJobTag(tag)
    names = ",".join(frame.columns)
    if n == 0 and empty_is_error:
        return statement_id, ERROR, 0, names, "empty result"
    return statement_id, "success", n, names, None


def run_candidates(
    spark: SparkSession,
    statements: Statements,
    timeout_seconds: float | None = 30.0,
    concurrency: int = 8,
    empty_is_error: bool = False,
    archive: str | None = None,
    complete: bool = True,
    ledger: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Run read-only statements and record how each one ended.

    ``statements`` are (statement_id, sql), as a frame of any size or a short list. The driver takes
    them in blocks of ``block`` and submits at most ``concurrency`` at a time; each runs distributed, computes
    all its columns, and only its row count comes back. A statement over the time limit is cancelled by
    its job tag; one that shared the machines with others until then is run again with none beside it, and
    only what that run takes counts. None sets no limit. With ``archive`` the rows of each statement are kept in that shared folder, in the
    form of ``canonical_row``.

    With ``ledger``, a shared folder, outcomes are kept there block by block; a later call with the same
    ledger goes on with the statements it lacks. Without, they come back as a local relation.
    """
    if not isinstance(statements, DataFrame):
        statements = local_frame(spark, statements, "statement_id string, sql string")
    judged = guard(statements.select("statement_id", "sql"), complete)
    refused = judged.filter("NOT ok").select(
        "statement_id",
        F.lit(ERROR).alias("status"),
        F.lit(None).cast("bigint").alias("row_count"),
        F.lit(None).cast("string").alias("columns"),
        F.lit("statement is incomplete or not read-only").alias("error"),
    )
    todo = judged.filter("ok").select("statement_id", "sql")
    ended: list[tuple] = []
    if ledger is not None:
        known = _kept(spark, ledger, OUTCOME_SCHEMA).select("statement_id")
        refused.join(known, "statement_id", "left_anti").write.mode("append").parquet(ledger)
        todo = todo.join(known, "statement_id", "left_anti")

    def work(item: tuple[str, str]) -> tuple:
        # Job tags live in thread-local properties; an inheritable thread keeps them apart.
        found: list[tuple] = []
        thread = InheritableThread(
            target=lambda: found.append(_run_one(spark, *item, timeout_seconds, empty_is_error, archive))
        )
        thread.start()
        thread.join()
        return found[0]

    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        for items in _blocks(todo, block):
            rows = list(pool.map(work, items))
            # Beside others a statement waits for cores, so its own time is known only alone.
            if concurrency > 1 and len(items) > 1:
                rows = [work(item) if row[4] == TIMEOUT else row for item, row in zip(items, rows)]
            rows.sort()
            if ledger is None:
                ended += rows
            else:
                local_frame(spark, rows, OUTCOME_SCHEMA).coalesce(1).write.mode("append").parquet(ledger)
    if ledger is not None:
        return spark.read.schema(OUTCOME_SCHEMA).parquet(ledger)
    return local_frame(spark, sorted(ended), OUTCOME_SCHEMA).unionByName(refused)


def _seconds(spark: SparkSession, sql: str, timeout_seconds: float | None, clock: Callable[[], float]) -> float | None:
    """Time of one run of a statement; None if it fails or runs over the limit."""
    began = clock()
    status = _run_one(spark, "timed", sql, timeout_seconds, False, None)[1]
    return clock() - began if status == "success" else None


def time_repeats(
    spark: SparkSession,
    questions: DataFrame,
    ledger: str,
    repeats: int = 5,
    timeout_seconds: float | None = 30.0,
    clock: Callable[[], float] = time.perf_counter,
    block: int = BLOCK,
) -> DataFrame:
    """(id, t_gold, t_pred): the upper median of ``repeats`` timed runs of each side.

    ``questions`` are id, gold_sql, predicted_sql. Nothing else of this session runs beside a timed
    statement, and gold and prediction take turns, so slow minutes fall on both. Runs that fail or time
    out are left out; a side without any has a NULL time. Times are kept in ``ledger`` block by block, and
    a later call goes on with the questions it lacks.
    """
    known = _kept(spark, ledger, TIMES_SCHEMA).select("id").distinct()
    todo = questions.select("id", "gold_sql", "predicted_sql").join(known, "id", "left_anti")
    for items in _blocks(todo, block):
        rows = [
            (question, side, run, _seconds(spark, sql, timeout_seconds, clock))
            for question, gold, predicted in items
            for run in range(repeats)
            for side, sql in (("gold", gold), ("pred", predicted))
        ]
        local_frame(spark, rows, TIMES_SCHEMA).coalesce(1).write.mode("append").parquet(ledger)

    def middle(side: str) -> Column:
        # As many values as repeats at most.
        times = F.sort_array(F.collect_list(F.when((F.col("side") == side) & F.col("seconds").isNotNull(), F.col("seconds"))))
        return F.get(times, F.floor(F.size(times) / 2).cast("int"))

    return (
        spark.read.schema(TIMES_SCHEMA)
        .parquet(ledger)
        .groupBy("id")
        .agg(middle("gold").alias("t_gold"), middle("pred").alias("t_pred"))
    )


def _printed_number(data_type: T.DataType, column: Column) -> Column:
    """All digits of a number. A binary fraction prints the shortest digits that mean it, but whole
    ones so large that these are not its own print in full, as whole numbers do."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("string")
    if not isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.cast("string")
    number, size = column.cast("double"), F.abs(column.cast("double"))
    sure = 2.0**24 if isinstance(data_type, T.FloatType) else 2.0**53
    # Both parts are exact: the first is a multiple of 2^63, the second what is left.
    high = F.floor(size / 2.0**63)
    low = size - high.cast("double") * 2.0**63
    whole = high.try_cast("decimal(19,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + low.try_cast("bigint").cast("decimal(19,0)")
    digits = F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("decimal(38,0)").cast("string"))
    return F.when((size >= sure) & (size < 1e37), digits).otherwise(column.cast("string"))


def _normal_digits(printed: Column) -> Column:
    """Sign, digits without outer zeros, and the power of ten behind them: one text per number."""
    body = F.ltrim(printed, F.lit("-"))
    mantissa = F.substring_index(body, "E", 1)
    power = F.coalesce(F.regexp_extract(body, r"E([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    digits = F.concat(F.substring_index(mantissa, ".", 1), fraction)
    short = F.rtrim(digits, F.lit("0"))
    power = power - F.length(fraction) + F.length(digits) - F.length(short)
    sign = F.when(printed.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    shown = F.concat(sign, F.ltrim(short, F.lit("0")), F.lit("e"), power.cast("string"))
    # Not a number and the infinities have no digits; zero has no sign.
    return F.when(~printed.rlike(r"^-?\d"), printed).when(F.ltrim(short, F.lit("0")) == "", F.lit("0")).otherwise(shown)


def _whole_digits(number: Column) -> Column:
    """``_normal_digits`` of a whole number, without patterns."""
    printed = number.cast("string")
    short = F.rtrim(printed, F.lit("0"))
    power = F.length(printed) - F.length(short)
    return F.when(number == 0, F.lit("0")).otherwise(F.concat(short, F.lit("e"), power.cast("string")))


def canonical_cell(data_type: T.DataType, column: Column) -> Column:
    """Text under which equal values of any types are equal: 1, 1.0, TRUE and decimal 1 are one
    number, text is never a number, NULL is NULL."""

    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        text_ = F.concat(F.lit("n"), _whole_digits(column.cast("bigint")))
    elif isinstance(data_type, T.NumericType):
        text_ = F.concat(F.lit("n"), _normal_digits(_printed_number(data_type, column)))
    elif isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        text_ = F.concat(F.lit("s"), column)
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text_ = F.concat(F.lit("j"), F.to_json(column))
    elif isinstance(data_type, T.NullType):
        text_ = F.lit(None).cast("string")
    else:
        text_ = F.concat(F.lit(f"{data_type.typeName()} "), column.cast("string"))
    return F.coalesce(F.concat(F.length(text_).cast("string"), F.lit(":"), text_), F.lit("-"))


def canonical_row(df: DataFrame) -> Column:
    """One text per row; rows of results of any width and types are equal if their texts are."""
    cells = [canonical_cell(f.dataType, F.col(f"`{f.name}`")) for f in df.schema]
    return F.concat_ws("|", *cells).alias("row") if cells else F.lit("").alias("row")


def evaluate(
    spark: SparkSession,
    predictions: DataFrame | Iterable[tuple[str, str, str]],
    folder: str,
    timeout_seconds: float | None = 30.0,
    concurrency: int = 8,
    repeats: int = 0,
    clock: Callable[[], float] = time.perf_counter,
    block: int = BLOCK,
) -> DataFrame:
    """Run gold and predicted statements, compare their rows, score every question.

    ``predictions`` are (id, gold_sql, predicted_sql), as a frame of any size or a short list. Returns
    id, score, equal, error (of the prediction) and gold_error. A statement used by many questions runs
    once; all comparisons are one job. "ambiguous" must be said by both or neither; where either side
    fails to run, or is NULL, the score is 0. With ``repeats``, statements of questions answered
    right are then timed (``time_repeats``), and t_gold and t_pred come along.

    ``folder`` is a shared folder. It keeps rows, outcomes and times, block by block; a call with the
    folder of one that was broken off goes on where that stopped. The driver holds a block at a time.
    """
    if isinstance(predictions, DataFrame):
        asked = predictions.select(F.col("id").cast("string").alias("id"), "gold_sql", "predicted_sql")
    else:
        asked = local_frame(spark, predictions, "id string, gold_sql string, predicted_sql string")

    def statement_of(sql: str) -> Column:
        return F.when(~F.col(sql).isin(AMBIGUOUS, ERROR), F.sha2(F.col(sql), 256))

    pairs = asked.withColumns({"gold": statement_of("gold_sql"), "pred": statement_of("predicted_sql")})
    sides = pairs.select("id", F.inline(F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gold").alias("statement_id"), F.col("gold_sql").alias("sql")),
        F.struct(F.lit("pred").alias("side"), F.col("pred").alias("statement_id"), F.col("predicted_sql").alias("sql")),
    ))).filter("statement_id IS NOT NULL")
    ended = run_candidates(
        spark,
        sides.select("statement_id", "sql").distinct(),
        timeout_seconds,
        concurrency,
        archive=f"{folder}/rows",
        complete=False,
        ledger=f"{folder}/outcomes",
        block=block,
    ).select("statement_id", "status", F.col("error").alias("said"))
    ran = ended.filter("status = 'success'").select("statement_id")
    if ran.isEmpty():
        rows = local_frame(spark, [], "row string, statement string")
    else:
        rows = spark.read.schema("row string, statement string").parquet(f"{folder}/rows")
    # Rows that a statement left before it failed do not count.
    rows = rows.withColumnRenamed("statement", "statement_id").join(ran, "statement_id", "left_semi")
    results = rows.distinct().join(sides.select("id", "side", "statement_id"), "statement_id")
    compared = batch_result_compare(results, ["row"], "id", questions=pairs)

    def end_of(side: str) -> DataFrame:
        return ended.select(
            F.col("statement_id").alias(side), F.col("status").alias(f"{side}_status"), F.col("said").alias(f"{side}_said")
        )

    whole = pairs.join(compared, "id").join(end_of("gold"), "gold", "left").join(end_of("pred"), "pred", "left")

    def failed(side: str, sql: str) -> Column:
        unclear = F.coalesce(F.col(sql) == AMBIGUOUS, F.lit(False))
        return ~unclear & (F.coalesce(f"{side}_status", F.lit(ERROR)) != "success")

    bad_gold, bad_pred = failed("gold", "gold_sql"), failed("pred", "predicted_sql")
    equal = F.col("equal") & ~bad_gold & ~bad_pred
    no_statement = F.lit("no statement")
    scored = whole.select(
        "id",
        score_of(F.coalesce("gold_sql", F.lit(ERROR)), F.coalesce("predicted_sql", F.lit(ERROR)), equal, bad_gold | bad_pred).alias("score"),
        equal.alias("equal"),
        F.when(bad_pred, F.coalesce("pred_said", no_statement)).alias("error"),
        F.when(bad_gold, F.coalesce("gold_said", no_statement)).alias("gold_error"),
    )
    if not repeats:
        return scored
    right = pairs.filter("gold IS NOT NULL AND pred IS NOT NULL").join(scored.filter("score = 1"), "id", "left_semi")
    return scored.join(time_repeats(spark, right, f"{folder}/times", repeats, timeout_seconds, clock, block), "id", "left")


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.NullType):
        return "null"
    return data_type.typeName()


def _decimal_of(data_type: T.DataType) -> T.DecimalType:
    return data_type if isinstance(data_type, T.DecimalType) else T.DecimalType(19, 0)


def _exact(own: T.DataType, column: Column, other: T.DataType) -> Column:
    """Decimals and whole numbers under one exact form: a decimal wide enough for both,
    or their digits as text where none is."""
    mine, theirs = _decimal_of(own), _decimal_of(other)
    scale = max(mine.scale, theirs.scale)
    whole = max(mine.precision - mine.scale, theirs.precision - theirs.scale)
    number = column.cast("bigint") if isinstance(own, T.BooleanType) else column
    if whole + scale <= 38:
        return number.cast(T.DecimalType(whole + scale, scale))
    digits = number.cast(T.DecimalType(38, mine.scale)).cast("string")
    return F.regexp_replace(digits, r"(?<=\.\d{0,40})0+$|\.0*$", "") if mine.scale else digits


def _comparable_pair(left: T.DataType, right: T.DataType, l_col: Column, r_col: Column, strict: bool):
    """Two columns brought to one type under which equal Python values are equal."""
    families = {_family(left), _family(right)} - {"null"}
    if len(families) > 1:
        return (
            F.concat(F.lit(f"{_family(left)}:"), l_col.cast("string")),
            F.concat(F.lit(f"{_family(right)}:"), r_col.cast("string")),
        )
    if families == {"number"}:
        exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
        if isinstance(left, exact) and isinstance(right, exact):
            return l_col.cast("bigint"), r_col.cast("bigint")
        fraction = (T.FloatType, T.DoubleType)
        if not isinstance(left, fraction) and not isinstance(right, fraction):
            return _exact(left, l_col, right), _exact(right, r_col, left)
        if strict and isinstance(left, T.DecimalType) != isinstance(right, T.DecimalType):
            # 0.1 as decimal is not 0.1 as binary fraction.
            return l_col.cast("double").cast("decimal(38,30)"), r_col.cast("double").cast("decimal(38,30)")
        return l_col.cast("double"), r_col.cast("double")
    if families == {"map"}:
        return F.sort_array(F.map_entries(l_col)), F.sort_array(F.map_entries(r_col))
    return l_col, r_col


def result_sets_equal(gold: DataFrame, pred: DataFrame, strict: bool = False) -> DataFrame:
    """One row (equal, only_gold, only_pred): equality as sets of positional rows.

    Row order, duplicates and column names do not matter, column order does.
    NULL equals NULL and 1 equals 1.0; text never equals a number. Both sides
    are reduced to distinct rows before the one shuffle that compares them.
    """
    width = max(len(gold.columns), len(pred.columns))
    names = [f"c{i}" for i in range(width)]
    if len(gold.columns) == len(pred.columns):
        g_cols, p_cols = [], []
        for i, (lf, rf) in enumerate(zip(gold.schema, pred.schema)):
            l_ref, r_ref = F.col(f"c{i}"), F.col(f"c{i}")
            l_out, r_out = _comparable_pair(lf.dataType, rf.dataType, l_ref, r_ref, strict)
            g_cols.append(l_out.alias(f"c{i}"))
            p_cols.append(r_out.alias(f"c{i}"))
        left = gold.toDF(*names).select(*g_cols)
        right = pred.toDF(*names).select(*p_cols)
    else:
        # Rows of different width never match.
        left, right = gold.select(F.lit("gold").alias("c0")), pred.select(F.lit("pred").alias("c0"))
        names = ["c0"]
    both = left.withColumn("__g", F.lit(1)).withColumn("__p", F.lit(0)).unionByName(
        right.withColumn("__g", F.lit(0)).withColumn("__p", F.lit(1))
    )
    rows = both.groupBy(*names).agg(F.max("__g").alias("g"), F.max("__p").alias("p"))
    return rows.agg(
        F.coalesce(F.min((F.col("g") == F.col("p"))), F.lit(True)).alias("equal"),
        F.count_if(F.col("p") == 0).alias("only_gold"),
        F.count_if(F.col("g") == 0).alias("only_pred"),
    )


def batch_result_compare(
    results: DataFrame,
    row: list[str],
    query_id: str = "query_id",
    side: str = "side",
    questions: DataFrame | None = None,
) -> DataFrame:
    """Set equality for every query of a long result table in one job.

    ``side`` is ``gold`` or ``pred``. With ``questions`` given, queries that
    returned nothing on both sides are reported as equal.
    """
    rows = results.groupBy(query_id, *row).agg(
        F.max(F.col(side) == "gold").alias("g"), F.max(F.col(side) == "pred").alias("p")
    )
    compared = rows.groupBy(query_id).agg(
        F.min(F.col("g") & F.col("p")).alias("equal"),
        F.count_if(F.col("g") & ~F.col("p")).alias("only_gold"),
        F.count_if(F.col("p") & ~F.col("g")).alias("only_pred"),
    )
    if questions is None:
        return compared
    return (
        questions.select(query_id)
        .join(compared, query_id, "left")
        .select(
            query_id,
            F.coalesce("equal", F.lit(True)).alias("equal"),
            F.coalesce("only_gold", F.lit(0)).alias("only_gold"),
            F.coalesce("only_pred", F.lit(0)).alias("only_pred"),
        )
    )


def score_of(gold_sql: Column, predicted_sql: Column, equal: Column, failed: Column | None = None) -> Column:
    """1 or 0: "ambiguous" must be said by both or by neither; a statement that
    failed to run scores 0; otherwise the result sets decide."""
    gold_unclear, pred_unclear = gold_sql == AMBIGUOUS, predicted_sql == AMBIGUOUS
    score = F.when(gold_unclear & pred_unclear, 1).when(gold_unclear | pred_unclear, 0)
    if failed is not None:
        score = score.when(failed, 0)
    return score.when(F.coalesce(equal, F.lit(False)), 1).otherwise(0).cast("bigint")


def score_questions(scored: DataFrame) -> DataFrame:
    """Adds ``score`` and ``error`` to rows with gold_sql, predicted_sql and correct.
    A prediction that is the word "error" cannot run."""
    failed = F.col("predicted_sql") == ERROR
    unclear = (F.col("gold_sql") == AMBIGUOUS) | (F.col("predicted_sql") == AMBIGUOUS)
    return scored.withColumns(
        {
            "score": score_of(F.col("gold_sql"), F.col("predicted_sql"), F.col("correct"), failed),
            "error": F.when(failed & ~unclear, F.lit("statement does not run")),
        }
    )


def map_status(status: Column, sql: Column) -> Column:
    """Tool status to prediction text."""
    return F.when(status == AMBIGUOUS, F.lit(AMBIGUOUS)).when(status == "success", sql).otherwise(F.lit(ERROR))
