"""Gradient-boosted trees on features of few values: rows are read as counts of equal rows,
in numpy or as passes over a Spark table of any size, with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradients are whole multiples of 1 / UNIT, so that their sums do not depend on the order of rows.
UNIT = float(1 << 30)


class Trees(NamedTuple):
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaves in zip(self.feature, self.threshold, self.leaves):
            out += leaves[descend(x, feature, threshold, inner) - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        return 1 / (1 + np.exp(-self.margins(x)))


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, first: int) -> np.ndarray:
    """The node of each row on the level that begins with node ``first``."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(x) and node[0] < first:
        node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
    return node


def cuts_of(values: np.ndarray, counts: np.ndarray, bins: int = 32) -> np.ndarray:
    """Quantiles of a feature, given as sorted values and how often each occurs."""
    ends = np.cumsum(counts)
    at = np.linspace(0, 1, bins)[:-1] * (ends[-1] - 1)
    low = np.floor(at)
    below, above = (values[np.searchsorted(ends, np.minimum(k, ends[-1] - 1), side="right")] for k in (low, low + 1))
    return np.unique(below + (above - below) * (at - low))


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Per feature how many cuts lie below the value."""
    places = [np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)]
    return np.stack(places, axis=1).astype(np.uint8) if places else np.zeros((len(x), 0), np.uint8)


class Pass(NamedTuple):
    """What one pass over the rows adds up: gradients by node of a level, feature and bin."""

    done: Trees
    feature: np.ndarray
    threshold: np.ndarray
    level: int
    width: int

    def sums(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.done.scores(x)
        nodes, width = 1 << self.level, self.width
        node = descend(x, self.feature, self.threshold, nodes - 1) - (nodes - 1)
        out = np.zeros((nodes, x.shape[1], width, 2), np.int64)
        for side, value in enumerate((y - p, p * (1 - p))):
            value = np.rint(value * UNIT) * n
            for k in range(x.shape[1]):
                out[:, k, :, side] = np.bincount(node * width + x[:, k], value, nodes * width).reshape(nodes, width)
        return out


def grow(
    widths: Sequence[int],
    rows: int,
    positive: int,
    sums: Callable[[Pass], np.ndarray],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    ridge: float = 1.0,
) -> Trees:
    """Logistic loss, Newton leaves; thresholds are bins, feature k has ``widths[k]`` of them.
    ``sums`` gives ``Pass.sums`` over all rows; it is asked ``depth`` times a tree."""
    mean = np.clip(positive / rows if rows else 0.0, 1e-3, 1 - 1e-3)
    inner = 2**depth - 1
    done = Trees(
        float(np.log(mean / (1 - mean))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    )
    for _ in range(trees if 0 < positive < rows else 0):
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        leaves = np.zeros(inner + 1)
        for level in range(depth):
            found = sums(Pass(done, feature, threshold, level, max(widths))) / UNIT
            for k in range(1 << level):
                at = (1 << level) - 1 + k
                g, h = found[k, 0].sum(axis=0)
                best, left = 1e-9, (g, h)
                whole = g**2 / (h + ridge)
                for j, width in enumerate(widths):
                    left_g, left_h = np.cumsum(found[k, j, : width - 1], axis=0).T
                    gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - whole
                    if len(gain) and gain.max() > best:
                        best, cut = gain.max(), int(gain.argmax())
                        feature[at], threshold[at], left = j, cut, (left_g[cut], left_h[cut])
                if level == depth - 1:
                    for side, (a, b) in enumerate((left, (g - left[0], h - left[1]))):
                        leaves[2 * at + 1 + side - inner] = rate * a / (b + ridge)
        done = Trees(
            done.base, *(np.vstack([old, new]) for old, new in zip(done[1:], (feature, threshold, leaves)))
        )
    return done


def on_values(trees: Trees, cuts: Sequence[np.ndarray]) -> Trees:
    """The same trees with the cuts of the features for their bins."""
    threshold = trees.threshold.copy()
    for place in np.argwhere(np.isfinite(threshold)):
        at = tuple(place)
        threshold[at] = cuts[trees.feature[at]][int(threshold[at])]
    return trees._replace(threshold=threshold)


def fit_trees(x: np.ndarray, y: np.ndarray, bins: int = 32, **options) -> Trees:
    """Trees on rows that are at hand, splits at quantiles of each feature."""
    cuts = [cuts_of(np.sort(column), np.ones(len(column), np.int64), bins) for column in x.T] if len(y) else []
    places, n = binned(x, cuts), np.ones(len(y))
    trees = grow([len(c) + 1 for c in cuts], len(y), int(y.sum()), lambda task: task.sums(places, y, n), **options)
    return on_values(trees, cuts)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` bytes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sums_over(rows: DataFrame, width: int) -> Callable[[Pass], np.ndarray]:
    """``Pass.sums`` over a table (bins binary, label int, n bigint) of any size: a pass of tasks
    that hold a batch each and send the sums only."""

    def sums(task: Pass) -> np.ndarray:
        shape = (1 << task.level, width, task.width, 2)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                label, n = (batch.column(name).to_numpy() for name in ("label", "n"))
                total += task.sums(matrix(batch.column("bins"), width), label, n)
            flat = total.reshape(-1, 2)
            at = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at, 0]), pa.array(flat[at, 1])], ["at", "g", "h"])

        parts = rows.select("bins", "label", "n").mapInArrow(run, "at bigint, g bigint, h bigint")
        table = parts.groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((int(np.prod(shape[:3])), 2), np.int64)
        out[table.column("at").to_numpy()] = np.stack([table.column(c).to_numpy() for c in ("g", "h")], axis=1)
        return out.reshape(shape)

    return sums
