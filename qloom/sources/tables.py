"""Tables of a database: parquet folders or a PostgreSQL server."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Fixed values, in seconds.
CONNECT_TIMEOUT = 15
STATEMENT_TIMEOUT = 30
FILTER_STATEMENT_TIMEOUT = 15


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet tables in a folder of any file system Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    found = [entry.getPath().getName() for entry in entries]
    return sorted(name[: -len(".parquet")] for name in found if name.endswith(".parquet"))


def load_tables(
    spark: SparkSession, folder: str, names: Sequence[str] | None = None, register: bool = False
) -> dict[str, DataFrame]:
    """Open every table of a database folder, or the named ones."""
    names = list(names) if names is not None else table_names(spark, folder)
    if not names:
        raise ValueError(f"no tables found in {folder}")
    tables = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in names}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def jdbc_options(url: str, table: str, statement_timeout: int = STATEMENT_TIMEOUT) -> dict[str, str]:
    separator = "&" if "?" in url else "?"
    return {
        "url": f"{url}{separator}connectTimeout={CONNECT_TIMEOUT}",
        "dbtable": table,
        "queryTimeout": str(statement_timeout),
        "sessionInitStatement": f"SET statement_timeout = {statement_timeout * 1000}",
    }


def jdbc_source(
    spark: SparkSession,
    url: str,
    table: str,
    statement_timeout: int = STATEMENT_TIMEOUT,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    parts: int = 1,
    **properties: str,
) -> DataFrame:
    """A PostgreSQL table with connect and statement timeouts. A numeric
    ``split_column`` with bounds reads it in parallel parts."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, statement_timeout), **properties)
    if split_column is not None:
        low, high = bounds or (0, 2**31)
        reader = reader.options(
            partitionColumn=split_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
        )
    return reader.load()
