"""Column statistics of whole tables.

Exact statistics rest on one table of value frequencies per source table, which
is aggregated map-side, so a value held by a third of all rows costs no more
than any other. ``profile_columns`` is the one-pass sketch form for tables that
are too large to count exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qloom.functions import text
from qloom.plans import local_frame, order_statistics, top_per_group

# Fixed values of the profile format.
ALL_VALUES_MAX = 15
SAMPLE_VALUES = 5
HINT_MAX = 10
SAMPLE_ROWS = 5
TEXT_MAX = 120
DISTINCT_SHARE = 0.1

#: Share of the rows that bounds the first values of a column.
SHARE = 0.01
#: One in so many hashes of a value is looked at before all values are.
GLANCE = 64

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType(), False),
        T.StructField("ordinal", T.LongType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("nullable", T.BooleanType(), False),
    ]
)

Tables = Mapping[str, DataFrame]


def is_scalar(data_type: T.DataType) -> bool:
    """Whether values of the type are profiled; nested ones are counted for NULLs only."""
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_scalar(f.dataType)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def schema_inventory(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table, ordinal, column, type, nullable) from the schemas; reads no data."""
    rows = [
        (name, i, field.name, field.dataType.simpleString(), field.nullable)
        for name, df in tables.items()
        for i, field in enumerate(df.schema, start=1)
    ]
    return local_frame(spark, rows, INVENTORY_SCHEMA)


def row_counts(tables: Tables) -> DataFrame:
    """Rows per table; a parquet count reads footers only."""
    return union_all(
        [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    )


def _per_column(df: DataFrame, columns: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Turn the one-row result of an all-columns aggregate into a row per column.
    Keys of ``measures`` are ``column/measure``."""
    wide = df.agg(*[m.alias(key) for key, m in measures.items()])
    names = list(dict.fromkeys(key.rsplit("/", 1)[1] for key in measures))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("ordinal"),
                F.lit(c).alias("column"),
                *[F.col(f"`{c}/{n}`").alias(n) for n in names],
            )
            for i, c in enumerate(columns, start=1)
        ]
    )
    return wide.select(F.inline(rows))


def null_fraction(name: str, df: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Share of NULLs per column in one pass, rounded to 3 digits; columns without
    any NULL are left out, so a share that rounds to 0.0 still shows."""
    measures: dict[str, Column] = {}
    for c in df.columns:
        missing = F.col(f"`{c}`").isNull()
        measures[f"{c}/nulls"] = F.count_if(missing)
        measures[f"{c}/null_frac"] = F.coalesce(F.avg(missing.cast("double")), F.lit(0.0))
    stats = _per_column(df, df.columns, measures)
    if not keep_zero:
        stats = stats.filter(F.col("nulls") > 0)
    return stats.select(F.lit(name).alias("table"), "column", "nulls", F.round("null_frac", 3).alias("null_frac"))


def counting_key(value: Column) -> Column:
    """Text that stands for a value while it is counted. A long value goes as the
    part that is ever shown and the hash of all of it, so documents are told apart
    by their whole text without being shuffled."""
    short = F.concat(F.substring(value, 1, TEXT_MAX), F.md5(value))
    return F.when(F.length(value) > TEXT_MAX + 32, short).otherwise(value)


def value_frequencies(name: str, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(table, column, value as text, n), NULLs left out: every scalar column is
    unpivoted and counted with partial aggregation before the one shuffle."""
    columns = list(columns or scalar_columns(df))
    return (
        _cells(df, columns)
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("table"), "column", "value", "n")
    )


def _cells(df: DataFrame, columns: Sequence[str], caps: Mapping[str, str] | None = None) -> DataFrame:
    """(column, value as text) of every cell that is not NULL nor above the column's cap."""

    def cell(c: str) -> Column:
        key = counting_key(F.col(f"`{c}`").cast("string"))
        kept = F.when(key <= F.lit(caps[c]), key) if caps and c in caps else key
        return F.struct(F.lit(c).alias("column"), kept.alias("value"))

    return df.select(F.inline(F.array(*[cell(c) for c in columns]))).filter(F.col("value").isNotNull())


def smallest_values(name: str, df: DataFrame, columns: Sequence[str] | None, k: int) -> DataFrame:
    """(table, column, value, rn): the first ``k`` distinct values of each column in text order.

    Of a share of the rows, the k-th smallest distinct value of a column is a bound: no larger
    value is among the first k of all rows. So larger ones go where they are read, and about
    ``k / SHARE`` distinct values of a column are shuffled, however many it has. A column with fewer
    than k values in that share has no bound, and few values to shuffle unless most are rare.
    The driver gets one value per column.
    """
    columns = list(columns or scalar_columns(df))
    first = top_per_group(_cells(df.sample(SHARE, seed=13), columns).distinct(), ["column"], [F.col("value")], k)
    bounds = first.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("cap")).filter(F.col("n") == k)
    caps = {row.column: row.cap for row in bounds.collect()}
    few = top_per_group(_cells(df, columns, caps).distinct(), ["column"], [F.col("value")], k)
    return few.select(F.lit(name).alias("table"), "column", "value", "rn")


def signed_distinct(n_distinct: Column, rows: Column) -> Column:
    """Server convention: a count, or minus the share of rows once distinct values
    make up more than a tenth of them."""
    share = n_distinct / rows
    return F.when(rows == 0, F.lit(0.0)).when(share > DISTINCT_SHARE, -share).otherwise(n_distinct.cast("double"))


def n_distinct(name: str, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct counts, also in signed form."""
    columns = list(columns or scalar_columns(df))
    total = df.agg(F.count(F.lit(1))).scalar()
    counted = value_frequencies(name, df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    listed = local_frame(df.sparkSession, [(c,) for c in columns], "column string")
    return (
        listed.join(counted, "column", "left")
        .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
        .withColumn("rows", total)
        .select(
            F.lit(name).alias("table"),
            "column",
            "distinct_values",
            F.round(signed_distinct(F.col("distinct_values"), F.col("rows")), 6).alias("n_distinct"),
        )
    )


def most_common_values(name: str, df: DataFrame, k: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values per column with their share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    frequent = top_per_group(
        value_frequencies(name, df, columns), ["table", "column"], [F.desc("n"), F.col("value")], k, "rank"
    )
    return frequent.withColumn("rows", total).select(
        "table",
        "column",
        "rank",
        text.truncate_text(F.col("value"), TEXT_MAX).alias("value"),
        "n",
        F.round(F.col("n") / F.col("rows"), 6).alias("freq"),
    )


def histogram_bounds(name: str, df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Equi-depth bounds 0…buckets: the smallest value, then the last value of each
    of ``buckets`` equally large parts. Exact for any orderable type."""

    def ranks(n: Column) -> Column:
        last = lambda i: F.greatest(F.lit(1), F.ceil(n * i / buckets)).cast("bigint")
        return F.transform(F.sequence(F.lit(0), F.lit(buckets)), lambda i: F.struct(i.cast("bigint"), last(i)))

    stats = order_statistics(df.select(column), [], column, ranks)
    return stats.select(
        F.lit(name).alias("table"), F.lit(column).alias("column"), F.col("label").alias("bound"), "value"
    )


def value_domain(
    name: str,
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_all: int = ALL_VALUES_MAX,
    sample: int = SAMPLE_VALUES,
) -> DataFrame:
    """All distinct values of a column when there are few, a sample otherwise.

    At most ``max_all + 1`` values per column survive the first step. Values are
    taken in ascending text order and cut like other long text.
    """
    few = smallest_values(name, df, columns, max_all + 1)
    listed = few.groupBy("table", "column").agg(
        F.array_sort(F.collect_list(F.struct("rn", text.truncate_text(F.col("value"), TEXT_MAX).alias("value")))).alias("v")
    )
    whole = F.size("v") <= max_all
    values = F.transform(F.when(whole, F.col("v")).otherwise(F.slice("v", 1, sample)), lambda s: s["value"])
    return listed.select(
        "table", "column", F.when(whole, "all_values").otherwise("sample_values").alias("kind"), values.alias("values")
    )


def value_domain_or_error(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``value_domain`` in which a column that cannot be read gives an error row
    and leaves the others alone."""
    good = [c for c in columns if c in df.columns and is_scalar(df.schema[c].dataType)]
    bad = [c for c in columns if c not in good]
    errors = local_frame(
        df.sparkSession,
        [(name, c, "error", [f"column {c} cannot be listed"[:80]]) for c in bad],
        "table string, column string, kind string, values array<string>",
    )
    return value_domain(name, df, good).unionByName(errors) if good else errors


def low_cardinality_hints(name: str, df: DataFrame, threshold: int = HINT_MAX) -> DataFrame:
    """Complete value lists as prompt text, for columns of 1…threshold values."""
    domain = value_domain(name, df, max_all=threshold)
    quoted = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema}
    as_text = F.col("column").isin(*[c for c, is_text in quoted.items() if is_text])
    shown = F.transform("values", lambda v: F.when(as_text, F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v))
    hint = F.concat(
        F.lit('All values of "'), "table", F.lit("."), "column", F.lit('": ['), F.array_join(shown, ", "), F.lit("]")
    )
    return domain.filter((F.col("kind") == "all_values") & (F.size("values") >= 1)).select("table", "column", hint.alias("hint"))


def sample_rows(
    tables: Tables, keys: Mapping[str, Sequence[str]], n: int = SAMPLE_ROWS, per_table: Mapping[str, int] | None = None
) -> DataFrame:
    """The first ``n`` rows of each table by key, as JSON text with long strings cut."""
    frames = []
    for name, df in tables.items():
        limit = (per_table or {}).get(name, n)
        first = df.orderBy(*keys[name]).limit(limit)
        cells = [
            (text.truncate_text(F.col(f.name), TEXT_MAX) if isinstance(f.dataType, T.StringType) else F.col(f.name)).alias(f.name)
            for f in df.schema
        ]
        frames.append(first.select(F.lit(name).alias("table"), F.to_json(F.struct(*cells)).alias("row")))
    return union_all(frames)


def profile_columns(name: str, df: DataFrame, k: int = 10, buckets: int = 10) -> DataFrame:
    """One pass over the table, sketches only: NULL share, approximate distinct
    count, frequent values and equi-depth bounds as text. State per task is
    bounded whatever the table holds."""
    columns = scalar_columns(df)
    fractions = [i / buckets for i in range(buckets + 1)]
    measures: dict[str, Column] = {}
    for c in columns:
        ref = F.col(f"`{c}`")
        kind = df.schema[c].dataType
        measures[f"{c}/null_frac"] = F.avg(ref.isNull().cast("double"))
        measures[f"{c}/rows"] = F.count(F.lit(1))
        measures[f"{c}/distinct_values"] = sketched_distinct(ref)
        measures[f"{c}/most_common"] = F.transform(
            F.call_function("approx_top_k", ref.cast("string"), F.lit(k), F.lit(k * 100)), lambda s: s["item"]
        )
        if isinstance(kind, T.NumericType):
            bounds = F.percentile_approx(ref, fractions, 10000)
            measures[f"{c}/bounds"] = F.transform(bounds, lambda v: v.cast("string"))
        else:
            text_of = ref.cast("string")
            measures[f"{c}/bounds"] = F.array(F.min(text_of), F.max(text_of))
    return _per_column(df, columns, measures).select(
        F.lit(name).alias("table"),
        "column",
        F.round("null_frac", 3).alias("null_frac"),
        "distinct_values",
        F.round(signed_distinct(F.col("distinct_values"), F.col("rows")), 6).alias("n_distinct"),
        "most_common",
        "bounds",
    )


def implied_edges(columns: DataFrame, primary_keys: DataFrame, declared: DataFrame) -> DataFrame:
    """Join edges not declared: a column named like another table's single-column
    primary key. Of tables sharing a key name the later one owns it.

    ``columns`` is (table, ordinal, column) with an ``order`` of tables,
    ``primary_keys`` (table, order, key: array), ``declared`` (table, columns: array).
    """
    owners = (
        primary_keys.filter(F.size("key") == 1)
        .groupBy(F.col("key")[0].alias("column"))
        .agg(F.max_by("table", "order").alias("owner"))
    )
    single = declared.filter(F.size("columns") == 1).select("table", F.col("columns")[0].alias("column"))
    return (
        columns.join(owners, "column")
        .filter(F.col("owner") != F.col("table"))
        .join(single, ["table", "column"], "left_anti")
        .select("table", "column", F.col("owner").alias("to_table"))
    )


def sketched_distinct(column: Column, log_buckets: int = 12) -> Column:
    """Approximate distinct count (standard error about 1.6 %); its state is one
    small binary value per task, however many columns are sketched at once."""
    hashed = F.when(column.isNotNull(), F.xxhash64(column))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(log_buckets))), F.lit(0))


def discover_keys(tables: Tables, max_share_missing: float = 0.1) -> DataFrame:
    """(table, column) of columns without NULLs whose values are all distinct.

    One sketch job over all tables rules out columns that are clearly repeated; it
    returns a row per column of the schema. The rest are counted exactly, value
    by value.
    """
    sketches = []
    for name, df in tables.items():
        columns = scalar_columns(df)
        measures: dict[str, Column] = {}
        for c in columns:
            ref = F.col(f"`{c}`")
            measures[f"{c}/rows"] = F.count(F.lit(1))
            measures[f"{c}/filled"] = F.count(ref)
            measures[f"{c}/distinct_values"] = sketched_distinct(ref)
        sketches.append(_per_column(df, columns, measures).withColumn("table", F.lit(name)))
    enough = F.col("distinct_values") >= F.col("rows") * (1 - max_share_missing)
    likely = union_all(sketches).filter((F.col("rows") > 0) & (F.col("filled") == F.col("rows")) & enough)

    frames = []
    for row in likely.select("table", "column").collect():
        counts = tables[row.table].groupBy(row.column).agg(F.count(F.lit(1)).alias("n"))
        frames.append(
            counts.filter("n > 1")
            .limit(1)
            .agg(F.count(F.lit(1)).alias("repeats"))
            .filter(F.col("repeats") == 0)
            .select(F.lit(row.table).alias("table"), F.lit(row.column).alias("column"))
        )
    spark = next(iter(tables.values())).sparkSession
    return union_all(frames) if frames else local_frame(spark, [], "table string, column string")


def _sketch_sets(tables: Tables, sets: Mapping[str, Sequence[tuple[str, ...]]]) -> dict[tuple[str, tuple[str, ...]], tuple[int, int, float]]:
    """(rows, rows without NULL, estimated distinct values) of column sets, from one job over all tables."""
    frames = []
    for name, wanted in sets.items():
        measures: dict[str, Column] = {}
        for at, columns in enumerate(wanted):
            filled = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in columns])
            measures[f"{at}/rows"] = F.count(F.lit(1))
            measures[f"{at}/filled"] = F.count_if(filled)
            measures[f"{at}/distinct_values"] = sketched_distinct(
                F.when(filled, F.xxhash64(*[F.col(f"`{c}`") for c in columns])), 14
            )
        if wanted:
            found = _per_column(tables[name], [str(k) for k in range(len(wanted))], measures)
            frames.append(found.withColumn("table", F.lit(name)))
    rows = union_all(frames).collect() if frames else []
    return {(r.table, sets[r.table][int(r.column)]): (r.rows, r.filled, r.distinct_values) for r in rows}


def _unrefuted(tables: Tables, sets: Mapping[str, Sequence[tuple[str, ...]]], share: int) -> set[tuple[str, tuple[str, ...]]]:
    """Column sets without a repeat among the values whose hash falls on one in ``share``; all values
    for a share of one. A table is read once for all its sets: a row gives one pair of 64-bit hashes
    per set, and those looked at are counted in one shuffle."""
    frames = []
    for name, wanted in sets.items():
        if not wanted:
            continue
        cells = []
        for at, columns in enumerate(wanted):
            refs = [F.col(f"`{c}`") for c in columns]
            cells.append(
                F.struct(F.lit(at).alias("at"), F.xxhash64(*refs).alias("h1"), F.xxhash64(F.lit(at), *refs).alias("h2"))
            )
        seen = tables[name].select(F.inline(F.array(*cells)))
        if share > 1:
            seen = seen.filter(F.pmod("h1", F.lit(share)) == 0)
        repeated = seen.groupBy("at", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        frames.append(repeated.select(F.lit(name).alias("table"), "at").distinct())
    rows = union_all(frames).collect() if frames else []
    refuted = {(r.table, sets[r.table][r.at]) for r in rows}
    return {(name, s) for name, found in sets.items() for s in found} - refuted


def discover_composite_keys(tables: Tables, most_columns: int = 2, missing: float = 0.05) -> DataFrame:
    """(table, columns): minimal sets of up to ``most_columns`` columns that hold no NULL and whose
    values together are all distinct; columns in schema order, joined by ", ".

    Sets grow by a column a level. A set is tried if no key is part of it, none of its columns has a
    NULL, and the product of its parts' distinct counts can reach the row count. A level has three jobs over
    all tables: sketches of all sets leave out those clearly repeated (a sketch errs by under one in a hundred,
    ``missing`` is five times that), a look at one value in 64 those with repeats that are not rare, and
    what is left is counted, by 128 bits of hash. Only names and counts reach the driver.
    """
    columns = {name: scalar_columns(df) for name, df in tables.items()}
    sets = {name: [(c,) for c in found] for name, found in columns.items()}
    keys: list[tuple[str, tuple[str, ...]]] = []
    sizes: dict[tuple[str, tuple[str, ...]], tuple[int, int, float]] = {}

    def grown(name: str, part: tuple[str, ...], level: int) -> Iterator[tuple[str, ...]]:
        """Sets of one column more, each reached once."""
        own = [set(k) for table, k in keys if table == name]
        rows, _, some = sizes[name, part]
        for c in columns[name][columns[name].index(part[-1]) + 1 :]:
            filled = sizes[name, (c,)][1] == rows
            # A set of the last level is of no use below the row count.
            reaches = level < most_columns or some * sizes[name, (c,)][2] >= (1 - missing) ** 2 * rows
            if filled and reaches and not any(k <= {*part, c} for k in own):
                yield (*part, c)

    for level in range(1, most_columns + 1):
        if level > 1:
            sets = {name: [g for part in found for g in grown(name, part, level)] for name, found in sets.items()}
        sizes |= _sketch_sets(tables, sets)
        sets = {name: [s for s in found if sizes[name, s][0] == sizes[name, s][1] > 0] for name, found in sets.items()}
        likely = {
            name: [s for s in found if sizes[name, s][2] >= (1 - missing) * sizes[name, s][0]] for name, found in sets.items()
        }
        glanced = _unrefuted(tables, likely, GLANCE)
        left = {name: [s for s in found if (name, s) in glanced] for name, found in likely.items()}
        proven = _unrefuted(tables, left, 1)
        keys += [(name, s) for name, found in left.items() for s in found if (name, s) in proven]
        sets = {name: [s for s in found if (name, s) not in proven] for name, found in sets.items()}
    spark = next(iter(tables.values())).sparkSession
    return local_frame(spark, [(name, ", ".join(s)) for name, s in keys], "table string, columns string")


Names = str | tuple[str, ...]
Pair = tuple[tuple[str, Names], tuple[str, Names]]


def same_suffix_pairs(tables: Tables, keys: Sequence[tuple[str, str]]) -> list[Pair]:
    """Candidate edges: columns of one type that share a key's name, table prefixes aside."""

    def bare(column: str) -> str:
        return column.split("_", 1)[-1]

    return [
        ((name, f.name), (key_table, key))
        for name, df in tables.items()
        for f in df.schema
        for key_table, key in keys
        if name != key_table and bare(f.name) == bare(key) and f.dataType == tables[key_table].schema[key].dataType
    ]


def discover_edges(tables: Tables, pairs: Sequence[Pair]) -> DataFrame:
    """(table, column, to_table, to_column, missing): an edge holds when every child
    value is found in the key. Both may be several columns, given as a tuple and shown joined by
    ", "; a child row with a NULL in one of them refers to nothing. Child values are made distinct,
    with partial aggregation, before they meet the key."""

    def side(table: str, names: Names) -> DataFrame:
        listed = [names] if isinstance(names, str) else names
        return tables[table].select(*[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(listed)])

    def shown(names: Names) -> Column:
        return F.lit(names if isinstance(names, str) else ", ".join(names))

    frames = []
    for (child_table, child), (key_table, key) in pairs:
        values = side(child_table, child).dropna().distinct()
        frames.append(
            values.join(side(key_table, key), values.columns, "left_anti")
            .agg(F.count(F.lit(1)).alias("missing"))
            .select(
                F.lit(child_table).alias("table"), shown(child).alias("column"), F.lit(key_table).alias("to_table"),
                shown(key).alias("to_column"), "missing",
            )
        )
    return union_all(frames)
