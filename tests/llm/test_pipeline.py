from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import pytest
from test_near import brute as near_brute
from test_exact import brute as exact_brute

import corpus_pipeline as pipeline
from qloom.llm.common import keep_ids, read_table
from qloom.llm import suite

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = read_table(spark, SF_DIR, "documents")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        out.append(docs.collect())
    return out


def test_stages_keep_columns_and_rows(steps):
    for before, after in zip(steps, steps[1:]):
        assert set(after) <= set(before) and len(after) <= len(before)


def test_toxic_documents_go(spark, steps):
    scores = {r.doc_id: r.predicted for r in suite.QUERIES["op4_toxicity"](spark, SF_DIR).collect()}
    assert {r.doc_id for r in steps[1]} == {k for k, bad in scores.items() if not bad}


def test_one_of_equal_texts_stays(steps):
    expected = {k for k, _, _, kept, _ in exact_brute((r.doc_id, r.text) for r in steps[1]) if kept}
    assert {r.doc_id for r in steps[2]} == expected


def test_one_of_near_copies_stays(steps):
    rows = sorted(steps[2], key=lambda r: r.doc_id)
    kept = {rows[k].doc_id for k, _, _, kept in near_brute([r.text for r in rows], 5) if kept}
    assert {r.doc_id for r in steps[3]} == kept


def test_benchmark_passages_go(spark, steps):
    items = [r.text.lower() for r in read_table(spark, SF_DIR, "benchmark").collect()]
    held = {r.doc_id for r in steps[3] if any(i in (r.text or "").lower() for i in items)}
    assert {r.doc_id for r in steps[4]} == {r.doc_id for r in steps[3]} - held


def test_all_that_is_left_is_packed(spark, steps):
    rows = pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps[4]}


def test_stages_take_odd_tables(spark, documents, odd, tmp_path):
    docs = documents([*odd, *odd])
    for name in ("labels", "benchmark"):
        read_table(spark, SF_DIR, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for table in (docs.limit(0), docs):
        for _, stage in pipeline.STAGES:
            table = stage(spark, table, str(tmp_path))
        table.collect()


def test_repeated_rows_are_one_document(documents):
    docs = documents(["a", "b"])
    kept = keep_ids(docs.union(docs), docs.filter("doc_id = 0"))
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns[0] == "doc_id"
