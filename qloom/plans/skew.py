"""Joins of a large frame to a lookup with unique keys, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 256
SAMPLE_FRACTION = 0.02
MIN_SAMPLED_ROWS = 1000
HOT_ROWS = int(MIN_SAMPLED_ROWS / SAMPLE_FRACTION)
SPREAD = 1024

_HOT = "__hot"
_ROUTE = "__route"
_FOUND = "__found"


def row_sample(df: DataFrame) -> DataFrame:
    """The rows hot keys are looked for in."""
    return df.sample(fraction=SAMPLE_FRACTION, seed=11)


def hot_keys(sampled: DataFrame, on: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """The most frequent keys of a row sample, at most ``HOT_KEYS`` of them.

    A key that holds a share worth splitting is in every sample of that size; a
    missed or a spurious key changes only the route its rows take, never the
    result.
    """
    counts = sampled.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    return most_rows(counts, on, "__n", MIN_SAMPLED_ROWS if min_rows is None else min_rows)


def most_rows(counts: DataFrame, on: Sequence[str], n: str, min_rows: int) -> DataFrame:
    """Keys with the largest counts, at most ``HOT_KEYS``."""
    return counts.filter(F.col(n) >= min_rows).orderBy(F.desc(n)).limit(HOT_KEYS).select(*on)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (one row per key) without a hot reducer.

    Rows of hot keys meet their lookup rows through a broadcast of at most
    ``HOT_KEYS`` rows and are then spread over ``SPREAD`` routes, where they match
    nothing new; all other rows take an ordinary shuffle join. ``how`` is ``left``,
    ``inner``, ``left_semi`` or ``left_anti``. ``hot`` gives the hot keys when
    the caller knows them more cheaply than a sample of ``facts`` tells. ``hashed`` is for
    lookups of short rows: a task holds its share of the lookup, which no hot key can make
    large, and the many facts pass by unsorted.
    """
    on = list(on)
    payload = [c for c in lookup.columns if c not in on]
    # One key type on both sides, since the route is a hash of the key.
    typed = lookup.withColumns({c: F.col(c).cast(facts.schema[c].dataType) for c in on})
    flagged = typed.withColumn(_FOUND, F.lit(True))

    if hot is None:
        hot = hot_keys(row_sample(facts.select(*on)), on)
    # A hot key without a lookup row is settled too: it is known to match nothing.
    few = hot.limit(HOT_KEYS)
    hot_rows = (few.hint("shuffle_hash") if hashed else few).join(flagged, on, "left").select(
        *on,
        *[F.col(c).alias(f"{c}{_HOT}") for c in payload],
        F.coalesce(F.col(_FOUND), F.lit(False)).alias(f"{_FOUND}{_HOT}"),
    )
    # NULL keys match nothing, so they are spread as well. The route is computed from
    # the key on both sides: a constant would be folded away and spread nothing.
    settled = F.col(f"{_FOUND}{_HOT}").isNotNull()
    for column in on:
        settled = settled | F.col(column).isNull()
    spread = 1 + F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns if _hashable(facts, c)]), F.lit(SPREAD))
    route = F.xxhash64(*on)
    routed = facts.join(F.broadcast(hot_rows), on, "left").withColumn(_ROUTE, F.when(settled, spread).otherwise(route))
    found_rows = flagged.withColumn(_ROUTE, route)
    joined = routed.join(found_rows.hint("shuffle_hash") if hashed else found_rows, [*on, _ROUTE], "left")
    found = F.coalesce(F.col(f"{_FOUND}{_HOT}"), F.col(_FOUND), F.lit(False))

    if how == "left_anti":
        return joined.filter(~found).select(*facts.columns)
    if how == "left_semi":
        return joined.filter(found).select(*facts.columns)
    if how == "inner":
        joined = joined.filter(found)
    elif how != "left":
        raise ValueError(f"unsupported join type {how!r}")
    return joined.select(
        *facts.columns,
        *[F.coalesce(F.col(f"{c}{_HOT}"), F.col(c)).alias(c) for c in payload],
    )


def _hashable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")
