"""A table of bits over a set of keys, small enough to be asked before rows are moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a table: 512 KB whatever the number of keys. A fuller table lets
#: more keys pass that are not in the set; what uses it joins the rest exactly.
WORDS = 1 << 16


def _word(key: Column) -> Column:
    return key.bitwiseAND(F.lit(WORDS - 1))


def _mask(key: Column) -> Column:
    """Two bits of the word of a key."""
    one = F.lit(1).cast("bigint")
    bits = [F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(63)).cast("int") for shift in (20, 40)]
    first, second = [F.call_function("shiftleft", one, bit) for bit in bits]
    return first.bitwiseOR(second)


def key_bits(keys: DataFrame) -> Column:
    """The table of the one ``bigint`` column of ``keys``, a hash, as a scalar subquery: no
    row carries a copy, and it may not stand inside a higher-order function. NULL keys are
    left out."""
    key = F.col(keys.columns[0])
    held = keys.filter(key.isNotNull()).select(_word(key).alias("word"), _mask(key).alias("mask"))
    empty = keys.sparkSession.range(WORDS).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = held.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return words.agg(F.transform(table, lambda w: w["mask"]).alias("masks")).scalar()


def may_hold(table: Column, key: Column) -> Column:
    """Whether a key can be in the set: never false for one that is."""
    mask = _mask(key)
    return table[_word(key).cast("int")].bitwiseAND(mask) == mask
