"""Helpers the operators share: stored intermediate tables, worker state, text chunks."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the folder may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where nothing is set, a
    temporary one, on a local master only."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="qloom-llm-")
    return f"{base.rstrip('/')}/qloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with no
    lineage to repeat when an executor is lost, and compressed."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more); NULL text counts as empty, other columns are left alone."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, so that later tasks of a
    reused worker find it. Must be a cache only: results never depend on it."""
    holder = sys.modules.setdefault("_qloom_worker_state", types.ModuleType("_qloom_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets of the rows in these bytes). A
    longer text is a run of its own.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, rows = 0, len(texts)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield row, end, whole[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def keep_rows(docs: DataFrame, decide: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text is approved of where it is
    read; no row is moved. ``decide`` is called once per task and gives a function from
    texts (NULL as empty) to flags."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        approve = decide()
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            yield batch.filter(pa.array(approve(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``, all columns as they are. Of
    rows repeated with id and text one is kept; a NULL id is never among them."""
    held = docs.join(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "doc_id", "left_semi")
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return held.withColumn("__copy", F.row_number().over(copies)).filter("__copy = 1").drop("__copy")
