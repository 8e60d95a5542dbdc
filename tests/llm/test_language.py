from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

from qloom.llm import language, suite
from qloom.llm.language import predict_languages

ENGLISH = "the weather of this morning was nice and they went with their friends to that house number {}"
GERMAN = "das wetter von heute morgen war schön und sie gingen mit ihren freunden zu dem haus nummer {}"


def test_learns_and_predicts(documents):
    texts = [(ENGLISH if k % 2 else GERMAN).format("x" * (k % 7)) for k in range(80)]
    docs = documents(texts, ["en" if k % 2 else "de" for k in range(80)])
    for r in predict_languages(docs).collect():
        assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
        assert 0 <= r.score <= 1


def test_odd_texts(documents, odd):
    docs = documents([*odd, *[ENGLISH] * 9], ["en"] * (len(odd) + 9))
    rows = {r.doc_id: r for r in predict_languages(docs).collect()}
    assert len(rows) == len(odd) + 9
    for k, text in enumerate(odd):
        expected = "en" if text and any(c.isalpha() for c in text) else "und"
        assert rows[k].lang_pred == expected
        assert expected == "en" or rows[k].score == 0


def test_without_labels_and_rows(documents):
    assert [r.lang_pred for r in predict_languages(documents(["abc"], [None])).collect()] == ["und"]
    assert predict_languages(documents([])).collect() == []


def test_label_of_a_row_is_no_input(spark, documents):
    texts = [(ENGLISH if k % 2 else GERMAN).format(k) for k in range(60)]
    docs = documents(texts, ["en" if k % 2 else "de" for k in range(60)])
    model = language.fit(docs, docs["doc_id"] < 50)
    one = language.identify(docs, model).collect()
    two = language.identify(docs.withColumn("lang", docs["source"]), model).collect()
    assert one == two


def test_held_out_accuracy(spark):
    from qloom.llm.common import read_table

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in read_table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in suite.QUERIES["op2_language"](spark, sf).collect() if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows)
    assert len(rows) > 100 and right >= 0.97 * len(rows)
