"""Question, pair and prediction files, corpora and result archives."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qloom.functions.binding import let
from qloom.plans import local_frame
from qloom.sources import large_files

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("difficulty", T.StringType()),
    ]
)
QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("SQL", T.StringType()),
        T.StructField("difficulty", T.StringType()),
    ]
)
PREDICTION_FILE = r"query_results_(.+?)(?:_seed(\d+))?\.json"


def load_records(
    spark: SparkSession, path: str | list[str], schema: T.StructType, array_file: bool = True, mode: str = "FAILFAST"
) -> DataFrame:
    """Records of a JSON array file, or of a folder with one record per line, which
    splits. A missing difficulty becomes ``unknown``. A malformed record fails the
    job, unless ``mode`` asks for NULLs (``PERMISSIVE``)."""
    rows = spark.read.schema(schema).option("multiLine", array_file).option("mode", mode).json(path)
    if "difficulty" in schema.names:
        rows = rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    return rows


# An object of one name whose text holds no escape is told by a pattern, which costs less than a JSON parser.
_ONE_TEXT = r'^\{\s*"(?:query|sql)"\s*:\s*"([^"\\]++)"\s*\}$'


def prediction_text(value: Column) -> Column:
    """Statement of a prediction value: plain text, or an object with ``query`` or ``sql``."""
    named = [F.nullif(F.get_json_object(value, f"$.{name}"), F.lit("")) for name in ("query", "sql")]
    parsed = F.coalesce(*named, F.lit(""))
    is_object = F.ltrim(value, F.lit(" \t\n\x0b\f\r")).startswith("{")
    found = let(F.regexp_extract(value, _ONE_TEXT, 1), lambda text: F.when(text != "", text).otherwise(parsed))
    return F.when(is_object, found).otherwise(F.coalesce(value, F.lit("")))


def load_predictions(
    spark: SparkSession, paths: str | list[str], whole_file: bool = True, name_pattern: str = PREDICTION_FILE
) -> DataFrame:
    """(arm, seed, question_id, sql) of id-to-SQL maps; arm and seed come from the
    file name. With ``whole_file=False`` each line is a map, so large sets split. A file
    or line that is no map fails the job and is named; blank ones hold nothing."""
    raw = (
        spark.read.text(paths, wholetext=whole_file, recursiveFileLookup=True)
        .select("value", F.col("_metadata.file_path").alias("__file"))
        .filter(F.col("value").rlike(r"\S"))
    )
    parsed = F.from_json("value", "map<string, string>")
    refused = F.raise_error(F.concat(F.lit("not a map of predictions: "), F.col("__file"))).cast("map<string, string>")
    seed = F.nullif(F.regexp_extract("__file", name_pattern, 2), F.lit("")).cast("int")
    # The name is searched once per map, not once per prediction. The map itself is read where it is
    # unfolded: of a column of maps, Spark asks the size first and reads it again.
    named = raw.select(
        "value", "__file", F.regexp_extract("__file", name_pattern, 1).alias("arm"), F.coalesce(seed, F.lit(0)).alias("seed")
    )
    entries = named.select("arm", "seed", F.explode(F.coalesce(parsed, refused)).alias("question_id", "__value"))
    return entries.select("arm", "seed", "question_id", prediction_text(F.col("__value")).alias("sql"))


def load_corpus(parts: Mapping[str, DataFrame], db_ids: Sequence[str] | None = None) -> DataFrame:
    """(source, db_id, sql): several query sets as one, rows without SQL left out."""
    frames = [
        df.select(F.lit(source).alias("source"), "db_id", "sql").filter(F.coalesce("sql", F.lit("")) != "")
        for source, df in parts.items()
    ]
    corpus = reduce(DataFrame.unionByName, frames)
    return corpus if db_ids is None else corpus.filter(F.col("db_id").isin(*db_ids))


def portable(df: DataFrame) -> DataFrame:
    """Decimals as double, dates and other non-JSON types as text."""
    kept = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.ArrayType, T.MapType, T.StructType)

    def cell(field: T.StructField) -> Column:
        ref = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return ref.cast("double").alias(field.name)
        return (ref if isinstance(field.dataType, kept) else ref.cast("string")).alias(field.name)

    return df.select(*[cell(f) for f in df.schema])


def write_records(df: DataFrame, path: str, by: str | None = "db_id", kind: str = "json") -> None:
    """Write JSON lines (or parquet), one folder per database. Non-ASCII text is
    kept as it is; NULL fields are written."""
    writer = portable(df).write.mode("overwrite").option("ignoreNullFields", False)
    if by is not None and by in df.columns:
        writer = writer.partitionBy(by)
    writer.format(kind).save(path)


def json_number(value: Column) -> Column:
    """A double as JSON writers print it: the shortest digits that mean it, and a power of ten
    only below 10^-6 and from 10^21 on. The smallest subnormal ones may show a digit more."""
    size = F.abs(value)

    def printed(places: int) -> Column:
        return F.format_string(f"%.{places}e", size)

    # Java prints a digit too many now and then.
    shortest = F.coalesce(*[F.when(printed(p).try_cast("double") == size, printed(p)) for p in (14, 15)], printed(16))

    def laid_out(text: Column) -> Column:
        digits = F.concat(F.substring(text, 1, 1), F.rtrim(F.substring_index(F.substring(text, 3, 40), "e", 1), F.lit("0")))
        power = F.substring_index(text, "e", -1).try_cast("int")
        return let(F.struct(digits.alias("d"), power.alias("p")), placed)

    def placed(number: Column) -> Column:
        digits, power = number["d"], number["p"]
        whole = F.rpad(digits, power + 1, F.lit("0"))
        rest = F.substr(digits, power + 2)
        plain = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -1 - power), digits)
        tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit(""))
        raised = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), power.cast("string"))
        return F.when(power.between(0, 20), plain).when(power.between(-6, -1), small).otherwise(raised)

    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    special = F.isnan(value) | (size == float("inf"))
    return F.when(special, value.cast("string")).otherwise(F.concat(sign, let(shortest, laid_out)))


def archive_results(results: DataFrame, keys: Sequence[str] = ("query_id", "side")) -> DataFrame:
    """(keys, row): each result row as JSON text."""
    cells = [c for c in results.columns if c not in keys]
    ready = portable(results.select(*cells, *[F.col(k).alias(f"__{k}") for k in keys]))

    def member(name: str) -> Column:
        ref = F.col(f"`{name}`")
        if isinstance(ready.schema[name].dataType, T.DoubleType):
            return F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), F.coalesce(json_number(ref), F.lit("null")))
        shown = F.to_json(F.struct(ref.alias(name)), {"ignoreNullFields": "false"})
        return let(shown, lambda m: F.substr(m, F.lit(2), F.length(m) - 2))

    return ready.select(
        *[F.col(f"__{k}").alias(k) for k in keys],
        F.concat(F.lit("{"), F.concat_ws(",", *map(member, cells)), F.lit("}")).alias("row"),
    )


def short_sha256(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def short_sha1(content: Column) -> Column:
    return F.substring(F.sha1(content), 1, 12)


def fingerprint_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256, sha1): short content hashes, NULL for files that are not there. A
    folder's hashes are those of the sorted list of its files' names and hashes. A file of more
    than a block is hashed block by block, unless its name makes Spark's readers unpack it."""
    wanted = local_frame(spark, [(p, _qualified(spark, p)) for p in paths], "path string, __full string")
    present = [p for p in paths if _exists(spark, p)]
    if not present:
        return wanted.selectExpr("path", "CAST(NULL AS STRING) AS sha256", "CAST(NULL AS STRING) AS sha1")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)

    def hashed(whole: DataFrame) -> DataFrame:
        return whole.select(
            F.col("path").alias("__file"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1")
        )

    listed = reader.load(present)
    files = hashed(listed.filter(F.col("length") <= large_files.BLOCK))
    # At most as many as there are blocks in the input.
    key = F.xxhash64("_metadata.file_path").alias("key")
    large = listed.filter(F.col("length") > large_files.BLOCK).select("path", "length", key).collect()
    packed = {r.path for r in large if large_files.is_compressed(spark, r.path)}
    if packed:
        files = files.unionByName(hashed(reader.load([large_files.as_given(p) for p in packed])))
    if len(packed) < len(large):
        rows = large_files.large_file_hashes(spark, [r for r in large if r.path not in packed])
        files = files.unionByName(local_frame(spark, rows, "__file string, sha256 string, sha1 string"))
    # The wanted paths are a list the caller wrote down.
    inside = F.col("__file").startswith(F.concat("__full", F.lit("/")))
    held = files.join(F.broadcast(wanted), (F.col("__file") == F.col("__full")) | inside)
    entry = F.struct(F.substr("__file", F.length("__full") + 1).alias("name"), "sha256", "sha1")
    folded = held.groupBy("path", "__full").agg(
        F.array_sort(F.collect_list(entry)).alias("__list"), F.bool_or(F.col("__file") == F.col("__full")).alias("__one")
    )

    def whole(kind: str, hashed) -> Column:
        rows = F.transform("__list", lambda f: F.concat_ws(":", f["name"], f[kind]))
        return F.when(F.col("__one"), F.col("__list")[0][kind]).otherwise(hashed(F.array_join(rows, "\n")))

    found = folded.select(
        "path",
        F.substring(whole("sha256", lambda t: F.sha2(t, 256)), 1, 16).alias("sha256"),
        F.substring(whole("sha1", F.sha1), 1, 12).alias("sha1"),
    )
    return wanted.select("path").join(found, "path", "left")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def _qualified(spark: SparkSession, path: str) -> str:
    target, system = _path(spark, path)
    return system.makeQualified(target).toString()


def table_version(df: DataFrame) -> DataFrame:
    """(rows, version): a content hash that does not depend on row order; any engine with
    md5 can repeat it. A cell is written with its length, NULL in its own way, so
    no two rows look alike. Sums keep copies of a row from cancelling each other."""
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]
    row = F.md5(F.concat_ws("|", *marked))

    def total(first: int) -> Column:
        return F.sum(F.conv(F.substring(row, first, 15), 16, 10).cast("decimal(38,0)")).cast("string")

    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws("-", F.coalesce(total(1), F.lit("0")), F.coalesce(total(17), F.lit("0"))).alias("version"),
    )


def merge_batches(*batches: DataFrame, key: Sequence[str] = ("question", "sql"), order: str = "pair_id") -> DataFrame:
    """Later batches added to earlier ones; of equal (question, sql) rows the one of
    the earliest batch stays. Copies are combined before the shuffle."""
    key = list(key)
    rest = [c for c in batches[0].columns if c not in key]
    tagged = [df.select(*key, F.struct(F.lit(i).alias("__b"), F.col(order).alias("__o"), *rest).alias("__r")) for i, df in enumerate(batches)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(*key).agg(F.min("__r").alias("__r"))
    return first.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*batches[0].columns)
