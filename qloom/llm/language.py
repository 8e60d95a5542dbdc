"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, fold_of, text_chunks, worker_state

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows the model is fitted on, per language, chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 2000
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
FOLDS, HELD_OUT = 5, 0


def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or a blank for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            lower = letter.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def features(texts: pa.Array, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed n-grams of whole texts, a run of rows at a time: (first row, end row,
    numbers of the n-grams, where each row's begin, letters per row).

    Letters are lower-cased, everything between words is one blank; a row has a
    blank before and behind it, and no n-gram crosses rows or is blank alone.
    """
    for first, end, data, offsets in text_chunks(texts):
        # Offsets in code points: every byte that does not continue a character starts one.
        opens = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        # A blank opens every row, and one closes the last.
        marked = np.append(np.insert(letters[codes], opens[:-1], 32), np.uint32(32))
        starts = opens[:-1] + np.arange(end - first)
        keep = np.ones(len(marked), bool)
        keep[1:] = (marked[1:] != 32) | (marked[:-1] != 32)
        keep[starts] = True
        before = np.concatenate(([0], np.cumsum(keep)))
        codes, starts = marked[keep].astype(np.uint64), before[starts]
        row_letters = np.add.reduceat((codes != 32).astype(np.int64), starts)
        mixed = codes * np.uint64(0x9E3779B97F4A7C15)
        rolling = np.zeros(len(codes), np.uint64)
        length = len(codes)
        # The blank that opens a row also closes the row before it.
        opening = np.zeros(length + max(ORDERS), bool)
        opening[starts] = True
        parts = np.zeros((len(ORDERS), length), np.int64)
        for n in range(1, max(ORDERS) + 1):
            rolling[: length - n + 1] = (
                rolling[: length - n + 1] * np.uint64(0xD6E8FEB86659FD93) + mixed[n - 1 :]
            )
            if n not in ORDERS:
                continue
            hashed = rolling ^ (rolling >> np.uint64(29)) ^ np.uint64(n)
            number = (hashed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % (FEATURES - 1) + 1
            number[max(0, length - n + 1) :] = 0
            # Feature 0 is nothing: n-grams that run over the blank that opens a row, or are a blank.
            for k in range(1, n - 1):
                number[opening[k : k + length]] = 0
            if n == 1:
                number[codes == 32] = 0
            parts[ORDERS.index(n)] = number
        yield first, end, parts, starts, row_letters


class Model(NamedTuple):
    languages: list[str]
    priors: np.ndarray
    #: (languages, features): log-probability of an n-gram in a language, 0 for feature 0.
    weights: np.ndarray


def fit(docs: DataFrame, training: Column, per_language: int = SAMPLE_PER_LANGUAGE, smoothing: float = 0.5) -> Model:
    """Fit on rows that meet ``training`` and have a language, at most about
    ``per_language`` of each, drawn by a hash of the id; equal texts count once."""
    labelled = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, FEATURES), np.float32))
    whole = 1 << 30
    share = {r["lang"]: min(whole, int(whole * per_language / r["count"]) + 1) for r in found}
    cut = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < cut)
    sample = sample.select("lang", "text", F.xxhash64("text").alias("hash")).dropDuplicates(["lang", "hash"])
    index = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = worker_state("letters", _letters)
        sums = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, end, parts, starts, _ in features(batch.column("text"), letters):
                owner = np.repeat(which[first:end], np.diff(np.append(starts, parts.shape[1]))) * FEATURES
                for numbers in parts:
                    sums += np.bincount(owner + numbers, minlength=sums.size).reshape(sums.shape)
        lang, number = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(sums[lang, number])],
            ["lang", "number", "n"],
        )

    counted = sample.select("lang", "text").mapInArrow(count, "lang int, number int, n bigint")
    # At most languages x features rows.
    table = counted.filter("number > 0").groupBy("lang", "number").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(languages), FEATURES))
    sums[table.column("lang").to_numpy(), table.column("number").to_numpy()] = table.column("n").to_numpy()
    sums[:, 1:] += smoothing
    weights = np.log(sums[:, 1:] / sums[:, 1:].sum(1, keepdims=True))
    weights = np.concatenate((np.zeros((len(languages), 1)), weights), 1).astype(np.float32)
    counts = np.array([r["count"] for r in found], float)
    return Model(languages, np.log(counts / counts.sum()), weights)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text).

    The log-probability matrix is broadcast; a run of rows is scored at a time.
    Texts that are NULL or have no letter, and all texts where the model knows no
    language, are ``und`` with score 0. Of equal scores the first language in
    alphabetical order is taken. The score is the posterior of the prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.priors, model.weights))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = worker_state("letters", _letters)
        languages, priors, weights = shared.value
        names = pa.array([*languages, UNDETERMINED])
        for batch in batches:
            best = np.full(batch.num_rows, len(languages), np.int64)
            posterior = np.zeros(batch.num_rows)
            for first, end, parts, starts, row_letters in features(batch.column("text"), letters) if languages else ():
                logs = priors + np.stack(
                    [np.add.reduceat(_sum_of(parts, weights, k), starts, dtype=np.float64) for k in range(len(languages))],
                    1,
                )
                top = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                known = row_letters > 0
                best[first:end] = np.where(known, top, len(languages))
                posterior[first:end] = np.where(known, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), names.take(pa.array(best)), pa.array(posterior)],
                ["doc_id", "lang_pred", "score"],
            )

    return documents_of(docs).mapInArrow(score, "doc_id bigint, lang_pred string, score double")


def _sum_of(parts: np.ndarray, weights: np.ndarray, language: int) -> np.ndarray:
    column = weights[language]
    out = column[parts[0]]
    for numbers in parts[1:]:
        out = out + column[numbers]
    return out


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from four folds of five, predict every row: doc_id, held_out, lang_pred, score.

    Rows without a language are not learned from; an empty table, or one without
    labels, predicts ``und`` throughout. Repeated rows are predicted each for itself;
    ``lang`` and the id only choose what is learned.
    """
    held_out = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
