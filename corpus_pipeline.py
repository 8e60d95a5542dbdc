"""Corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes what its predecessor kept and all but the last return the columns
of ``documents``. NULL and empty texts pass the filters (of them exact
deduplication leaves one); an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qloom.llm import decontam, exact, near, packing, toxicity
from qloom.llm.common import fold_of, keep_ids, read_table, stored

NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a field learned from the labels does not reject; it learns from
    two folds of three, as the scoring query does."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    training = fold_of(F.col("doc_id").cast("bigint"), toxicity.FOLDS) != toxicity.HELD_OUT
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels, training))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return keep_ids(docs, exact.exact_duplicates(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles, the one with the smallest id."""
    return keep_ids(docs, near.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT).filter("kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The first stage is a learned classifier, which SQL cannot tell; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
