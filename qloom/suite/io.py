"""Sources and sinks, by reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from qloom.operators import profile
from qloom.sources import records
from qloom.sources import tables as table_source
from qloom.suite import fixtures
from qloom.suite.calls import shared_folder
from qloom.suite.registry import query, table

ALL = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
).split()


@query(
    "s1_load_tables",
    " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}""" for t in ALL),
)
def load_tables(spark, sf_dir):
    return profile.row_counts(table_source.load_tables(spark, sf_dir))


EVAL_SCHEMA = T.StructType(
    [f for f in records.QUESTION_SCHEMA if f.name != "SQL"] + [T.StructField("gold_sql", T.StringType())]
)


@query("s2_load_records", "SELECT question_id, db_id, question, evidence, gold_sql, difficulty FROM f_eval", ("f_eval",))
def load_records(spark, sf_dir):
    folder = shared_folder(spark)
    records.write_records(fixtures.eval_set(spark, sf_dir), folder, by=None)
    return records.load_records(spark, folder, EVAL_SCHEMA, array_file=False)


@query(
    "s3_load_predictions",
    """SELECT arm, seed, CAST(question_id AS VARCHAR) AS question_id,
CASE WHEN question_id % 20 = 0 AND seed = 2 THEN '' ELSE predicted_sql END AS sql FROM f_scores""",
    ("f_scores",),
)
def load_predictions(spark, sf_dir):
    # Maps of at most 100 questions per line; seed 1 and 2 use the two object forms.
    said = fixtures.scores(spark, sf_dir).withColumns(
        {
            "shard": F.floor(F.col("question_id") / 1000),
            "name": F.format_string("query_results_%s_seed%d.json", "arm", "seed"),
            "value": F.when(F.col("seed") == 0, F.to_json(F.array("predicted_sql")))
            .when(F.col("seed") == 1, F.concat(F.lit("["), F.to_json(F.struct(F.col("predicted_sql").alias("query"))), F.lit("]")))
            .when(F.col("question_id") % 20 == 0, F.lit("[{}]"))
            .otherwise(F.concat(F.lit("["), F.to_json(F.struct(F.col("predicted_sql").alias("sql"))), F.lit("]"))),
        }
    )
    bare = F.expr("substring(value, 2, length(value) - 2)")
    entry = F.concat(F.lit('"'), F.col("question_id").cast("string"), F.lit('": '), bare)
    maps = said.groupBy("name", "shard").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value")
    )
    folder = shared_folder(spark)
    maps.select("name", "value").write.partitionBy("name").text(folder)
    return records.load_predictions(spark, folder, whole_file=False)


@query(
    "s4_load_corpus",
    """SELECT 'pairs' AS source, db_id, sql FROM f_pairs WHERE db_id IN ('db_F', 'db_O') AND pair_id % 11 <> 0
UNION ALL SELECT 'questions', db_id, gold_sql FROM f_eval WHERE db_id IN ('db_F', 'db_O')""",
    ("f_pairs", "f_eval"),
)
def load_corpus(spark, sf_dir):
    gappy = fixtures.pairs(spark, sf_dir).withColumn("sql", F.when(F.col("pair_id") % 11 != 0, F.col("sql")))
    asked = fixtures.eval_set(spark, sf_dir).withColumn("sql", F.col("gold_sql"))
    return records.load_corpus({"pairs": gappy, "questions": asked}, ["db_F", "db_O"])


@query("s6_write_records", "SELECT db_id, pair_id, question, sql, difficulty FROM f_pairs", ("f_pairs",))
def write_records(spark, sf_dir):
    folder = shared_folder(spark)
    columns = ["db_id", "pair_id", "question", "sql", "difficulty"]
    pairs = fixtures.pairs(spark, sf_dir).select(*columns)
    records.write_records(pairs, folder)
    return spark.read.schema(pairs.schema).json(folder).select(*columns)


@query(
    "s7_archive_results",
    """SELECT query_id, side, CAST(to_json({'c0': c0, 'c1': c1}) AS VARCHAR) AS row FROM f_results""",
    ("f_results",),
)
def archive_results(spark, sf_dir):
    return records.archive_results(fixtures.results(spark, sf_dir))


@query(
    "s8_fingerprint_text",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS sha256, substr(sha1(text), 1, 12) AS sha1 FROM documents",
)
def fingerprint_text(spark, sf_dir):
    content = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", records.short_sha256(content).alias("sha256"), records.short_sha1(content).alias("sha1")
    )


@query("s8_fingerprint_files")
def fingerprint_files(spark, sf_dir):
    """Hashes of the table files; no SQL reads their bytes."""
    return records.fingerprint_files(spark, [f"{sf_dir}/{t}.parquet" for t in (*ALL, "absent")])


CELL = "coalesce(concat(length(CAST({0} AS VARCHAR)), ':', {0}), '-')"


@query(
    "s8_table_version",
    f"""WITH r AS (SELECT md5(concat_ws('|', {", ".join(CELL.format(c) for c in ("doc_id", "text", "lang", "source", "n_chars"))})) AS h FROM documents)
SELECT count(*) AS rows, concat(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)), '-', sum(CAST(concat('0x', substr(h, 17, 15)) AS BIGINT))) AS version
FROM r""",
)
def table_version(spark, sf_dir):
    return records.table_version(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query(
    "s9_merge_batches",
    """WITH u AS (SELECT 0 AS b, * FROM f_pairs WHERE pair_id % 2 = 0 UNION ALL SELECT 1, * FROM f_pairs WHERE pair_id % 2 <> 0 OR pair_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question, sql ORDER BY b, pair_id) AS rn FROM u)
SELECT pair_id, db_id, question, sql FROM r WHERE rn = 1""",
    ("f_pairs",),
)
def merge_batches(spark, sf_dir):
    pairs = fixtures.pairs(spark, sf_dir).select("pair_id", "db_id", "question", "sql")
    return records.merge_batches(pairs.filter("pair_id % 2 = 0"), pairs.filter("pair_id % 2 <> 0 OR pair_id % 3 = 0"))
