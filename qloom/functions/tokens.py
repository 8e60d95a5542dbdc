"""Token counts of text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = r"\w+|[^\w\s]"


def token_count(text: Column) -> Column:
    """Number of word and punctuation pieces; runs in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECE)), F.lit(0)).cast("bigint")


def token_count_with(load_encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """A counter for any tokenizer: ``load_encoder`` runs once per task and returns
    a function from text to tokens."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_encoder()
        for batch in batches:
            yield batch.fillna("").map(lambda value: len(encode(value))).astype("int64")

    return count
