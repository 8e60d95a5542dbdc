from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qloom.llm import crf
from qloom.llm.toxicity import fit, reject_toxic, score_documents, toxicity

BAD = ["dreadoaf", "dreadlump", "nastikin", "vilebag"]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 3])
    starts = np.array([0, 1, 6])
    evidence, t = rng.normal(size=9), rng.normal(size=(2, 2))
    got, pairs = crf.forward_backward(evidence, t, crf.Chains.of(starts, lengths))
    for s, n in zip(starts, lengths):
        total, one, both = 0.0, np.zeros(n), np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(evidence[s + k] * y[k] for k in range(n)) + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            one += w * np.array(y)
            both[1:] += w * np.array([y[k] * y[k - 1] for k in range(1, n)])
        assert np.allclose(got[s : s + n], one / total)
        assert np.allclose(pairs[s : s + n], both / total)


@pytest.fixture
def corpus(spark, documents, prose, odd):
    rng = random.Random(0)
    texts, labels = [], []
    for k in range(240):
        words = prose(k, 60).split()
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        texts.append(" ".join(words))
        labels.append((k, 1, int(k % 4 == 0), "t"))
    labels += [(3, 1, 0, "t"), (4, 0, 1, "t"), (5, 1, None, "t"), (None, 1, 1, "t"), (9_999, 1, 1, "t")]
    return documents([*texts, *odd]), spark.createDataFrame(labels, "doc_id int, quality int, toxic int, text string"), texts


def test_scores_and_spans(corpus, odd):
    docs, labels, texts = corpus
    rows = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(rows) == 240 + len(odd)
    for k, text in enumerate(texts):
        assert rows[k].predicted == int(k % 4 == 0) == int(rows[k].score >= 0.7)
        for s in rows[k].spans:
            assert all(w.strip(".").lower() in BAD for w in text[s.start : s.end].split())
    for k in range(240, 240 + len(odd)):
        assert 0 <= rows[k].score < 0.7 and rows[k].spans == []


def test_filter_keeps_columns_and_rows(corpus):
    docs, labels, _ = corpus
    model = fit(docs, labels, F.col("doc_id") % 3 != 0)
    kept = reject_toxic(docs, model)
    assert kept.columns == docs.columns
    expected = {r.doc_id for r in score_documents(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == expected


def test_without_labels_or_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    (row,) = toxicity(documents(["some words"]), labels).collect()
    assert row.predicted == 0
    assert toxicity(documents([]), labels).collect() == []


def test_held_out_accuracy(spark):
    from qloom.llm import suite
    from qloom.llm.common import read_table

    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").collect()}
    rows = [r for r in suite.QUERIES["op4_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    clean = [r for r in rows if not truth[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    toxic = [r for r in rows if truth[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)


def test_the_driver_takes_no_texts(corpus, monkeypatch):
    """The fit runs in a task, so the driver's memory does not rise with its texts."""

    def refuse(*_):
        raise AssertionError("texts in the driver")

    docs, labels, _ = corpus
    monkeypatch.setattr(type(docs), "toArrow", refuse)
    model = fit(docs, labels, F.col("doc_id") % 3 != 0)
    assert model.weights.any() and model.weights.dtype == np.float32
