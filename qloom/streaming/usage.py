"""Running token totals while responses arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from qloom.operators.usage import usage_measures


def usage_stream(calls: DataFrame, by: str = "arm") -> DataFrame:
    """Streaming totals per arm. The state holds one row per arm, so it needs no
    watermark; starting with a new checkpoint folder resets the counter."""
    total = F.col("total_tokens") if "total_tokens" in calls.columns else None
    return calls.groupBy(by).agg(*usage_measures(total))


def start_usage_totals(totals: DataFrame, folder: str, checkpoint: str, by: str = "arm") -> StreamingQuery:
    """Write the arms each micro-batch changed under ``folder``, one subfolder per
    batch. A batch that is repeated after a failure overwrites its own subfolder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_usage_totals(spark: SparkSession, folder: str, by: str = "arm") -> DataFrame:
    """The latest totals of every arm."""
    written = spark.read.parquet(folder)
    values = [c for c in written.columns if c not in (by, "epoch")]
    latest = written.groupBy(by).agg(F.max_by(F.struct(*values), "epoch").alias("latest"))
    return latest.select(by, "latest.*")
