"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qloom.llm import crf
from qloom.llm.common import documents_of, fold_of, keep_rows, text_chunks
from qloom.llm.decontam import split
from qloom.llm.words import Hasher, Words, seeded, sentence_starts

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled rows of each class the model is fitted on, drawn by a hash of the id.
SAMPLE_PER_CLASS = 2000
BITS = 18
#: Beginnings of words that are features beside the word, in bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
LONGEST_CHAIN = 128
#: A feature may mark tokens as toxic if the share of toxic texts that have it is this many times
#: that of clean texts, and if it explains this share of the toxic texts, but no fewer than that number.
RATIO, SHARE, SUPPORT = 6.0, 0.01, 4
#: Tokens that explain a toxic text.
NEED = 2
#: Words added to a text when its density is taken, so a few words are no evidence.
FILL = 50
#: Marginals below this one add up to nothing, however long a text is.
FLOOR = 0.15
MOST_CHAINS = 30_000


class Tokens(NamedTuple):
    words: Words
    features: np.ndarray
    chains: crf.Chains


def tokens_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Tokens:
    """Words of lower-cased text with hashed features, in chains of a sentence each; a sentence
    of more than ``LONGEST_CHAIN`` words is several chains."""
    words = split(data, offsets)
    sums = hasher.prefix(data)
    hashes = hasher.ranges(sums, words.starts, words.ends)
    sizes = words.ends - words.starts
    columns = [seeded(hashes, 1)]
    for k, n in enumerate(BEGINNINGS):
        # A word shorter than the beginning has the word itself there.
        part = hasher.ranges(sums, words.starts, words.starts + np.minimum(sizes, n))
        columns.append(seeded(part, 2 + k))
    features = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in columns], 1)
    opens = np.flatnonzero(sentence_starts(data, words, hashes))
    lengths = np.diff(np.append(opens, len(hashes)))
    if len(lengths) and lengths.max() > LONGEST_CHAIN:
        pieces = -(-lengths // LONGEST_CHAIN)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(opens, pieces) + number * LONGEST_CHAIN
        ends = np.minimum(starts + LONGEST_CHAIN, np.repeat(opens + lengths, pieces))
        opens, lengths = starts, ends - starts
    return Tokens(words, features, crf.Chains.of(opens, lengths))


class Model(NamedTuple):
    weights: np.ndarray
    transition: np.ndarray
    #: Intercept and weights of the columns of ``sums_of``.
    document: np.ndarray


def sums_of(marginal: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(rows, 3): log(1 + expected toxic tokens), the largest marginal, and log(1 + expected
    toxic tokens of a hundred), where a text counts as ``FILL`` words longer; 0 without words."""
    out = np.zeros((len(rows) - 1, 3))
    sizes = np.diff(rows)
    some = np.flatnonzero(sizes)
    if len(some):
        expected = np.add.reduceat(np.where(marginal >= FLOOR, marginal, 0.0), rows[some])
        out[some, 0] = np.log1p(expected)
        out[some, 1] = np.maximum.reduceat(marginal, rows[some])
        out[some, 2] = np.log1p(100 * expected / (sizes[some] + FILL))
    return out


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -50, 50)))


def fit_document(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; rows count as ``share``, the ridge keeps separable data finite."""
    weights = np.zeros(x.shape[1] + 1)
    design = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.eye(len(weights))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = probability(x, weights)
        slope = design.T @ (share * (y - p)) - penalty @ weights
        curve = (design * (share * p * (1 - p))[:, None]).T @ design + penalty
        change = np.linalg.solve(curve, slope)
        weights = weights + np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return weights


def sample(docs: DataFrame, labels: DataFrame, training: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most ``per_class`` labelled rows of each class, and the rows of each class."""
    judged = (
        labels.filter(training & F.col("toxic").isin(0, 1))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    drawn = [
        judged.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for label in (0, 1)
    ]
    # At most 2 x per_class ids.
    texts = documents_of(docs).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("text", "toxic")
    return texts, {r["toxic"]: r["count"] for r in judged.groupBy("toxic").count().collect()}


def fit(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows.

    The labels are of documents. Tokens are labelled by them first: features
    (a word, or how it begins) that hardly any clean text has and that explain toxic
    texts mark their tokens there as toxic, all others are clean. The field is
    trained on all sentences with such features and as many others again, and a
    logistic curve over its marginals on the documents' own labels.
    """
    drawn, rows = sample(docs, labels, training, per_class)

    def learn(table: pa.Table) -> pa.Table:
        model = fit_sample(table.sort_by([("hash", "ascending"), ("toxic", "ascending")]), rows, per_class)
        return pa.table({name: [part.tobytes()] for name, part in zip(Model._fields, model)})

    # The bounded sample is one group, so that the driver holds the model only.
    hashed = drawn.select(F.xxhash64("text").alias("hash"), "text", "toxic")
    found = hashed.groupBy().applyInArrow(learn, "weights binary, transition binary, document binary").first()
    if found is None:
        return nothing_learned()
    return Model(
        np.frombuffer(found.weights, np.float32),
        np.frombuffer(found.transition, np.float64).reshape(2, 2),
        np.frombuffer(found.document, np.float64),
    )


def nothing_learned() -> Model:
    return Model(np.zeros((1 << BITS) + 1, np.float32), np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0, 0.0]))


def fit_sample(table: pa.Table, rows: dict[int, int], per_class: int) -> Model:
    """Fit on (text, toxic) rows in a fixed order; ``rows`` has the labelled rows of each class."""
    # Equal texts count once.
    table = table.group_by("text").aggregate([("toxic", "max")])
    texts = pc.utf8_lower(table.column("text").combine_chunks())
    y = table.column("toxic_max").to_numpy().astype(float)
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        return nothing_learned()
    hasher = Hasher()
    parts = [(first, tokens_of(data, offsets, hasher)) for first, _, data, offsets in text_chunks(texts)]

    counts = np.zeros((2, size))
    for first, tokens in parts:
        row = np.repeat(np.arange(len(tokens.words.rows) - 1), np.diff(tokens.words.rows))
        once = np.unique(row[:, None] * size + tokens.features.astype(np.int64))
        label = y[first + once // size].astype(int)
        counts += np.bincount(label * size + once % size, minlength=2 * size).reshape(2, size)
    # Clean texts as many as there are toxic ones.
    counts[0] *= y.sum() / (1 - y).sum()
    marks = explaining(parts, y, counts)

    features, labelled, starts, lengths, at = [], [], [], [], 0
    rng = np.random.default_rng(3)
    for first, tokens in parts:
        toxic_row = y[first + np.repeat(np.arange(len(tokens.words.rows) - 1), np.diff(tokens.words.rows))] == 1
        token = toxic_row & marks[tokens.features].any(1)
        order = np.argsort(tokens.chains.starts)
        chain_starts, chain_lengths = tokens.chains.starts[order], tokens.chains.lengths[order]
        marked = marks[tokens.features].any(1).astype(int)
        toxic_chain = np.add.reduceat(marked, chain_starts) > 0 if len(chain_starts) else np.zeros(0, bool)
        others = np.flatnonzero(~toxic_chain)
        few = rng.permutation(others)[: 2 * int(toxic_chain.sum()) + 20]
        for k in np.sort(np.concatenate((np.flatnonzero(toxic_chain), few))):
            place = slice(chain_starts[k], chain_starts[k] + chain_lengths[k])
            if len(starts) < MOST_CHAINS:
                features.append(tokens.features[place])
                labelled.append(token[place])
                starts.append(at)
                lengths.append(chain_lengths[k])
                at += int(chain_lengths[k])
    chains = crf.Chains.of(np.array(starts), np.array(lengths))
    weights, transition = crf.fit(
        np.concatenate(features), np.concatenate(labelled).astype(float), chains, size
    )
    weights = weights.astype(np.float32)
    x = np.concatenate([sums_of(mark(tokens, weights, transition), tokens.words.rows) for _, tokens in parts])
    # Every class counts as often as it is among all labelled rows.
    share = np.where(y == 1, max(1.0, rows[1] / per_class), max(1.0, rows[0] / per_class))
    return Model(weights, transition, fit_document(x, y, share))


def explaining(parts: list[tuple[int, Tokens]], y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Flags of the features that mark tokens as toxic; ``counts`` has the clean and toxic
    texts of each feature, on one scale.

    Chosen one by one: the feature that is in most toxic texts of fewer than ``NEED``
    marked tokens, counting tokens that are not marked yet, less ``RATIO`` times the
    clean texts it is in; of equals the most specific one. Words that toxic texts share by chance, as copies do, explain nothing new.
    """
    allowed = (counts[1] >= SUPPORT) & (counts[1] >= RATIO * counts[0])
    least = max(SUPPORT, SHARE * y.sum())
    places, owners = [], []
    for first, tokens in parts:
        row = first + np.repeat(np.arange(len(tokens.words.rows) - 1), np.diff(tokens.words.rows))
        some = np.flatnonzero((y[row] == 1) & allowed[tokens.features].any(1))
        places.append(tokens.features[some].astype(np.int64))
        owners.append(row[some])
    features, owner = np.concatenate(places), np.concatenate(owners)
    # Equal tokens of a text count once.
    _, kept = np.unique(np.column_stack((owner, features)), axis=0, return_index=True)
    features, owner = features[kept], owner[kept]
    chosen = np.zeros(len(allowed), bool)
    explained = np.zeros(len(y), np.int64)
    free = np.ones(len(owner), bool)
    order = [0, *range(len(BEGINNINGS), 0, -1)]
    while True:
        open_ = free & (explained[owner] < NEED)
        pairs = [
            np.unique(owner[open_] * len(allowed) + features[open_, k]) % len(allowed) for k in order
        ]
        gains = np.stack([np.bincount(p[allowed[p]], minlength=len(allowed)) for p in pairs])
        gains = gains - np.where(gains > 0, RATIO * counts[0], 0)
        # The first column of the largest gain is the most specific.
        column, best = np.unravel_index(gains.argmax(), gains.shape)
        if gains[column, best] < least:
            return chosen
        chosen[best] = True
        hit = free & (features == best).any(1)
        free &= ~hit
        explained += np.bincount(owner[hit], minlength=len(y))


def mark(tokens: Tokens, weights: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginal probability of every token to be toxic."""
    evidence = np.full(len(tokens.features), float(weights[-1]))
    for column in tokens.features.T:
        evidence += weights[column]
    return crf.forward_backward(evidence, transition, tokens.chains)[0]


def spans(marginal: np.ndarray, words: Words, row: int) -> list[tuple[int, int]]:
    """Byte ranges of neighbouring words that are rather toxic than not."""
    first, end = int(words.rows[row]), int(words.rows[row + 1])
    hit = np.flatnonzero(marginal[first:end] >= 0.5) + first
    out: list[tuple[int, int]] = []
    for k in hit.tolist():
        if out and out[-1][2] == k:
            out[-1] = (out[-1][0], int(words.ends[k]), k + 1)
        else:
            out.append((int(words.starts[k]), int(words.ends[k]), k + 1))
    return [(s, e) for s, e, _ in out]


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and spans (code points, end exclusive) of every row.

    NULL and empty texts have no spans and the score of a text without toxic words. Offsets are
    those of the lower-cased text, which differ from the text's own only
    behind letters whose lower case is longer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = Model(*shared.value), Hasher()
        for batch in batches:
            lower = pc.utf8_lower(batch.column("text"))
            scores, found = np.zeros(batch.num_rows), []
            for first, end, data, offsets in text_chunks(lower):
                tokens = tokens_of(data, offsets, hasher)
                marginal = mark(tokens, own.weights, own.transition)
                x = sums_of(marginal, tokens.words.rows)
                scores[first:end] = probability(x, own.document)
                for row in range(end - first):
                    begin, places = int(offsets[row]), []
                    if x[row, 1] >= 0.5:
                        for low, high in spans(marginal, tokens.words, row):
                            s = len(data[begin:low].tobytes().decode())
                            places.append({"start": s, "end": s + len(data[low:high].tobytes().decode())})
                    found.append(places)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(found, kind),
                ],
                ["doc_id", "score", "predicted", "spans"],
            )

    schema = "doc_id bigint, score double, predicted int, spans array<struct<start: bigint, end: bigint>>"
    return documents_of(docs).mapInArrow(score, schema)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def decide():
        own, hasher = Model(*shared.value), Hasher()

        def approve(texts: pa.Array) -> np.ndarray:
            good = np.ones(len(texts), bool)
            for first, end, data, offsets in text_chunks(pc.utf8_lower(texts)):
                tokens = tokens_of(data, offsets, hasher)
                x = sums_of(mark(tokens, own.weights, own.transition), tokens.words.rows)
                good[first:end] = probability(x, own.document) < threshold
            return good

        return approve

    return keep_rows(docs, decide)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from two folds of three, score every row: doc_id, held_out, score, predicted, spans.

    A document with several labels counts as toxic if any says so; other labels than 0 and 1 are
    not learned from. Without labels of both classes every text has one low score.
    Repeated rows are scored each for itself, an empty table gives an empty table;
    other columns are ignored.
    """
    held_out = fold_of(F.col("doc_id").cast("bigint"), FOLDS) == HELD_OUT
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held_out)
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")
