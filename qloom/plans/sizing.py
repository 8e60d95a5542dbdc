"""Small frames the driver holds, and broadcasts whose size is checked first."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_INLINE_ROWS = 4096


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str) -> DataFrame:
    """Rows known to the driver as a local relation: Catalyst sees its exact size,
    and no Python worker is needed to read it."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)


def inline_if_small(df: DataFrame, max_rows: int = MAX_INLINE_ROWS) -> tuple[DataFrame, bool]:
    """Return ``df`` as a local relation when it has at most ``max_rows`` rows.

    Reads ``max_rows + 1`` rows at most, so the driver never holds more than the
    bound. Small: the exact rows become a local relation, which Catalyst can
    broadcast knowing its size. Too large: the frame comes back unchanged and
    the caller joins it by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True
