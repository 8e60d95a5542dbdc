"""Ranks, samples and order statistics that never sort a whole group in one task.

Two ideas carry all of it: counting per bucket first (map-side combined), so
only the bucket that holds the wanted rank is ever sorted; and buckets that are
even by construction, either prefixes of a hash or ranges of the values as Spark's
range partitioning draws them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qloom.plans.lineage import cut_lineage
from qloom.plans.sizing import inline_if_small
from qloom.plans.skew import lookup_join

PREFIX_DIGITS = 4


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group. Catalyst limits each partition to ``k``
    rows per group before the shuffle, so a hot group moves ``k`` rows per task."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= k)


def hash_key(seed: object, key: Column) -> Column:
    """The pseudo-random order all sampling uses: ``md5(seed|key)``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_cutoffs(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    sizes: Mapping[str, Callable[[Column], Column]],
    seed: object = 0,
) -> DataFrame:
    """Per group and label the hash at which the first ``size(n)`` rows end.

    ``key`` must be unique within its group. Returns (groups, label, n, size,
    cutoff); a size of 0 yields no row, a size above n is clamped to n.
    """
    groups = list(groups)
    hashed = df.select(*groups, hash_key(seed, F.col(key)).alias("__h"))
    bucketed = hashed.withColumn("__b", F.substring("__h", 1, PREFIX_DIGITS))
    counts = bucketed.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__c"))

    # At most 16^PREFIX_DIGITS rows per group reach these windows.
    whole = Window.partitionBy(*groups)
    running = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(
        *groups,
        "__b",
        "__c",
        F.sum("__c").over(running).alias("__end"),
        F.sum("__c").over(whole).alias("n"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.least(size(F.col("n")).cast("bigint"), F.col("n")).alias("size"))
            for label, size in sizes.items()
        ]
    )
    targets = (
        placed.select("*", F.inline(wanted))
        .filter((F.col("__end") - F.col("__c") < F.col("size")) & (F.col("size") <= F.col("__end")))
        .select(*groups, "label", "n", "size", "__b", (F.col("size") - F.col("__end") + F.col("__c")).alias("__need"))
    )
    targets, _ = inline_if_small(targets)
    inside = bucketed.join(targets, [*groups, "__b"])
    order = Window.partitionBy(*groups, "label").orderBy("__h")
    return (
        inside.withColumn("__rn", F.row_number().over(order))
        .filter(F.col("__rn") == F.col("__need"))
        .select(*groups, "label", "n", "size", F.col("__h").alias("cutoff"))
    )


def first_by_hash(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    size: Callable[[Column], Column],
    seed: object = 0,
    flag: str | None = None,
) -> DataFrame:
    """The first ``size(n)`` rows of each group in hash order.

    With ``flag`` every row is kept and a boolean column tells whether it was
    chosen. The full frame is only compared with one cutoff per group.
    """
    cutoffs = hash_cutoffs(df, groups, key, {"first": size}, seed).select(*groups, "cutoff")
    if groups:
        cutoffs, small = inline_if_small(cutoffs)
        joined = df.join(F.broadcast(cutoffs), list(groups), "left") if small else lookup_join(df, cutoffs, groups)
    else:
        joined = df.withColumn("cutoff", cutoffs.select("cutoff").scalar())
    chosen = F.coalesce(hash_key(seed, F.col(key)) <= F.col("cutoff"), F.lit(False))
    if flag is not None:
        return joined.withColumn(flag, chosen).drop("cutoff")
    return joined.filter(chosen).drop("cutoff")


def _ranges(df: DataFrame, groups: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their counts, range partitioned by group and value, and where
    each range lies in its group.

    Returns (groups, value, __c, __p) and (groups, __p, __in, __before, n): rows of the group in the
    range, in earlier ones, and in all. The first is written once, for ranges are drawn anew
    whenever a plan runs. There are as many ranges as shuffle partitions, so they grow with the
    cluster, and the second frame has a row per range and one more per group at most.
    """
    keys = list(groups)
    freq = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranged = freq.repartitionByRange(*keys, value).withColumn("__p", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = ranged.groupBy(*keys, "__p").agg(F.sum("__c").alias("__in"))
    places = places.select(
        *keys, "__p", "__in", (F.sum("__in").over(earlier) - F.col("__in")).alias("__before"), F.sum("__in").over(whole).alias("n")
    )
    return ranged, places


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]] | Callable[[Column], Column],
) -> DataFrame:
    """Exact values at given 1-based ranks per group, NULLs left out.

    ``ranks`` maps a label to a function of the row count, or is one function
    giving an array of (label, rank). Returns (groups, label, n, value). Only
    ranges that hold a wanted rank are sorted, each in a task of its own.
    """
    keys = list(groups)
    ranged, places = _ranges(df, keys, value)
    if callable(ranks):
        wanted = ranks(F.col("n"))
    else:
        wanted = F.array(*[F.struct(F.lit(label), rank(F.col("n")).cast("bigint")) for label, rank in ranks.items()])
    targets = (
        places.select("*", F.inline(wanted).alias("label", "__rank"))
        .filter((F.col("__before") < F.col("__rank")) & (F.col("__rank") <= F.col("__before") + F.col("__in")))
        .select(*keys, "label", "n", "__p", (F.col("__rank") - F.col("__before")).alias("__need"))
    )
    # Several ranks may lie in one range; its values are sorted once for all of them.
    asked = targets.groupBy(*keys, "__p", "n").agg(F.collect_list(F.struct("label", "__need")).alias("__asked"))
    inside = Window.partitionBy(*keys, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.join(asked, [*keys, "__p"]).withColumn("__run", F.sum("__c").over(inside))
    hits = F.filter(
        "__asked", lambda t: (F.col("__run") - F.col("__c") < t["__need"]) & (t["__need"] <= F.col("__run"))
    )
    return run.select(*keys, "n", value, F.explode(hits).alias("__hit")).select(
        *keys, "__hit.label", "n", F.col(value).alias("value")
    )


def exact_median(df: DataFrame, groups: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(groups, n, median): the mean of the two middle values for even n."""
    middle = order_statistics(
        df, groups, value, {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2)}
    )
    return middle.groupBy(*groups, "n").agg(F.avg(F.col("value").cast("double")).alias(name))


def ranks_of_values(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """``rank()`` over the whole frame, as a table (value, rank) with one row per
    distinct value; no un-partitioned window is involved. NULLs are left out."""
    ranged, places = _ranges(df, [], value)
    inside = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("__before") + F.sum("__c").over(inside)
    rank = F.col("n") - upto + 1 if descending else upto - F.col("__c") + 1
    return ranged.join(places, "__p").select(value, rank.cast("bigint").alias("rank"))
