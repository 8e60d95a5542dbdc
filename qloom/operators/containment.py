"""Joins on ``a LIKE '%' || b || '%'`` without meeting every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qloom.functions.binding import let
from qloom.plans import cut_lineage, key_bits, may_hold


def _grams(value: Column, size: Column) -> Column:
    """Distinct substrings of one length."""

    def pieces(count: Column) -> Column:
        starts = F.sequence(F.lit(1), count)
        return F.when(count > 0, F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, size))))

    return F.coalesce(let(F.length(value) - size + 1, pieces), F.array().cast("array<string>"))


def _hashed(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))


def containment_join(
    texts: DataFrame, patterns: DataFrame, text_id: str, text: str, pattern: str, gram: int = 3
) -> DataFrame:
    """(texts, pattern) for every text that contains a pattern; patterns distinct and not empty.

    A text holding a pattern holds each of its n-grams, so candidates come from
    an equality join on one n-gram per pattern, the one fewest texts hold, and
    only candidates are searched. Patterns shorter than ``gram`` are n-grams
    themselves. N-grams travel as hashes, and those no pattern has are dropped by a table of
    bits before any row moves; a hash that stands for two n-grams only adds candidates.
    """
    wanted = patterns.select(pattern, F.least(F.length(pattern), F.lit(gram)).alias("__size"))
    pieces = wanted.select(pattern, F.explode(_hashed(_grams(F.col(pattern), F.col("__size")))).alias("__g"))
    vocabulary = pieces.select("__g").distinct()
    sizes = F.array(*[F.lit(i) for i in range(1, gram + 1)])
    pieces_of_texts = F.flatten(F.transform(sizes, lambda size: _grams(F.col(text), size)))
    read = texts.select(text_id, F.explode(_hashed(pieces_of_texts)).alias("__g"))
    held = cut_lineage(read.filter(may_hold(key_bits(vocabulary), F.col("__g"))).join(vocabulary, "__g", "left_semi"))
    spread = held.groupBy("__g").agg(F.count(F.lit(1)).alias("__df"))
    rarest = Window.partitionBy(pattern).orderBy("__df", "__g")
    # A pattern with an n-gram no text holds is in no text.
    probes = (
        pieces.join(spread, "__g", "left")
        .withColumn("__df", F.coalesce("__df", F.lit(0)))
        .withColumn("__rn", F.row_number().over(rarest))
        .filter((F.col("__rn") == 1) & (F.col("__df") > 0))
        .select(pattern, "__g")
    )
    candidates = held.join(probes, "__g").select(text_id, pattern)
    return texts.join(candidates, text_id).filter(F.contains(F.col(text), F.col(pattern)))
