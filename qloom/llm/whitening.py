"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

What is shared grows with the width of the vectors only: tasks send sums and scatter matrices
(width times width), the driver factors one such matrix, and rows stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Entries this large and larger have no exact whole number.
LARGEST = 1 << 40
#: Rows whose centred entries are multiplied at once.
BLOCK_ROWS = 8192
ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"


class Spectrum(NamedTuple):
    """Eigenvalues of the covariance, largest first, components as columns, and its trace."""

    values: np.ndarray
    components: np.ndarray
    trace: float


def pivoted_cholesky(scatter: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """L with ``L @ L.T == scatter``, one column per step. Each step takes the
    dimension with most scatter left, so columns come in falling size and the steps end
    where no scatter above ``tolerance`` times the largest is left: their number is the rank."""
    width = len(scatter)
    left = np.diag(scatter).astype(np.float64).copy()
    # A smaller remainder is rounding of the subtractions, not scatter.
    floor = max(tolerance, width * np.finfo(np.float64).eps) * max(left.max(initial=0.0), 0.0)
    open_ = np.ones(width, bool)
    factor = np.zeros((width, 0))
    for _ in range(width):
        at = int(np.argmax(np.where(open_, left, -np.inf)))
        if not left[at] > floor:
            break
        column = scatter[:, at] - factor @ factor[at]
        column[~open_] = 0.0
        column[at] = left[at]
        column = column / np.sqrt(left[at])
        factor = np.column_stack((factor, column))
        open_[at] = False
        left -= column * column
    return factor


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each two of ``n`` columns meet once."""
    seats = list(range(n + n % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < n]
        if pairs:
            rounds.append((np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated until each two are orthogonal to double precision."""
    work = factor.copy()
    rounds = rounds_of_pairs(work.shape[1])
    limit = 4 * np.finfo(np.float64).eps
    for _ in range(most_sweeps):
        turned = False
        for left, right in rounds:
            a, b = work[:, left], work[:, right]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > limit * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            tangent = np.where(turn, tangent, 0.0)
            cosine = 1 / np.sqrt(1 + tangent * tangent)
            sine = cosine * tangent
            work[:, left], work[:, right] = cosine * a - sine * b, sine * a + cosine * b
        if not turned:
            return work
    raise RuntimeError(f"columns are not orthogonal after {most_sweeps} sweeps")


def spectrum(scatter: np.ndarray, n: int) -> Spectrum:
    """Eigenvalues and components of ``scatter / n``. Squared column norms of the rotated factor
    are eigenvalues, its normalised columns components; directions without scatter have none."""
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    squares = (rotated * rotated).sum(0)
    order = np.argsort(-squares, kind="stable")
    squares = squares[order]
    # Each component with its largest entry positive, so that a run can be repeated.
    components = rotated[:, order] / np.sqrt(squares)
    if components.size:
        components *= np.sign(components[np.abs(components).argmax(0), np.arange(components.shape[1])])
    return Spectrum(squares / n, components, float(np.trace(scatter)) / n)


def whole_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flags of the vectors that remain, their entries floor(64 c) + 1000000 as longs, a row each)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)  # NULL entries become NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    fit = lengths > 0
    fit[owner[~np.isfinite(flat)]] = False
    widths = np.unique(lengths[fit])
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths[:5].tolist()}")
    values = flat[fit[owner]]
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"entries from {LARGEST} on have no exact whole number")
    whole = np.floor(SCALE * values).astype(np.int64) + OFFSET
    return fit, whole.reshape(int(fit.sum()), -1)


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")


def count_and_sums(embeddings: DataFrame) -> tuple[int, np.ndarray]:
    """Number of remaining vectors and the exact sum of each dimension, from one row per task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            whole = whole_entries(batch.column("embedding"))[1]
            if len(whole):
                n += len(whole)
                part = [int(x) for x in (whole - OFFSET).sum(0)]
                if sums is not None and len(sums) != len(part):
                    raise ValueError(f"vectors of different widths: {[len(sums), len(part)]}")
                sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict(
                {"at": range(len(sums)), "n": [n] * len(sums), "total": [str(s) for s in sums]},
                pa.schema([("at", pa.int64()), ("n", pa.int64()), ("total", pa.string())]),
            )

    parts = _vectors(embeddings).mapInArrow(add, "at bigint, n bigint, total string")
    total = F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), total).orderBy("at").collect()
    if not rows:
        return 0, np.zeros(0, object)
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors of different widths")
    n = rows[0].n
    return n, np.array([int(r.total) + n * OFFSET for r in rows], object)


def _centre(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S/n as nearest whole numbers and remainders, so that ``(x - whole) - rest`` loses nothing."""
    whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole, strict=True)], np.float64)
    return whole, rest


def scatter_of(embeddings: DataFrame, n: int, sums: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """Sum of ``z z'`` over all remaining rows: z is x centred, and then, if given, times ``into``.

    A task sums its rows in blocks and sends one matrix, in rows that Spark adds up.
    """
    whole_mean, rest = _centre(n, sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            whole = whole_entries(batch.column("embedding"))[1]
            for k in range(0, len(whole), BLOCK_ROWS):
                z = (whole[k : k + BLOCK_ROWS] - whole_mean).astype(np.float64) - rest
                if into is not None:
                    z = z @ into
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"at": range(len(total)), "line": list(total)},
                pa.schema([("at", pa.int64()), ("line", pa.list_(pa.float64()))]),
            )

    parts = _vectors(embeddings).mapInArrow(add, "at bigint, line array<double>")
    cells = parts.select("at", F.posexplode("line").alias("other", "x"))
    width = len(sums) if into is None else into.shape[1]
    out = np.zeros((width, width))
    for row in cells.groupBy("at", "other").agg(F.sum("x").alias("x")).collect():
        out[row.at, row.other] = row.x
    return (out + out.T) / 2


def whiten(embeddings: DataFrame, most_components: int = 32) -> DataFrame:
    """Whitened embeddings, one row per remaining vector and component.

    Vectors that are NULL or empty, or hold NULL, NaN or infinite entries, are left out. An entry
    c becomes the long ``x = floor(64 c) + 1000000``. With n remaining vectors and sums S, V is the
    covariance of x (divisor n, centred before multiplying). Returns vec_id, component (from 1, by
    falling eigenvalue), n, deviation (sum over dimensions of (n x - S)^2), whitened ((x - S/n) on the
    component, over the root of its eigenvalue), explained (eigenvalue over trace) and
    identity_error (largest entry of the whitened vectors' own covariance, measured on all rows,
    minus the identity).

    Components end at the rank of V: a direction without scatter (1e-12 of the largest) has no whitened value. With equal
    vectors only, or none, the result is empty. Repeated rows give repeated rows and count each; a NULL
    vec_id stays NULL; other columns are ignored. deviation is exact; where it exceeds a long it is NULL.
    Vectors of different widths, and entries from 2^40 on, raise a ValueError. Equal eigenvalues
    leave their components free to turn within their plane.

    Four scans of the vectors, no shuffle of rows. The driver holds one matrix of width times width.
    """
    spark = embeddings.sparkSession
    empty = f"{ROWS}, identity_error double"
    n, sums = count_and_sums(embeddings)
    if not n:
        return spark.createDataFrame([], empty)
    found = spectrum(scatter_of(embeddings, n, sums), n)
    count = min(most_components, len(found.values))
    if not count:
        return spark.createDataFrame([], empty)
    into = found.components[:, :count] / np.sqrt(found.values[:count])
    error = float(np.abs(scatter_of(embeddings, n, sums, into) / n - np.eye(count)).max())
    explained = found.values[:count] / found.trace
    whole_mean, rest = _centre(n, sums)
    remains = np.array([int(s) - n * int(w) for s, w in zip(sums, whole_mean, strict=True)], object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(k, BLOCK_ROWS)
                fit, whole = whole_entries(block.column("embedding"))
                ids = block.column("vec_id").filter(pa.array(fit))
                near = whole - whole_mean
                white = (near.astype(np.float64) - rest) @ into
                rows = len(near)
                number = np.tile(np.arange(1, count + 1, dtype=np.int32), rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(rows), count))),
                        pa.array(number),
                        pa.array(np.full(rows * count, n, np.int64)),
                        _deviation(near, n, remains).take(pa.array(np.repeat(np.arange(rows), count))),
                        pa.array(white.reshape(-1)),
                        pa.array(np.tile(explained, rows)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return _vectors(embeddings).mapInArrow(project, ROWS).withColumn("identity_error", F.lit(error))


def _deviation(near: np.ndarray, n: int, remains: np.ndarray) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2 as longs, where x - mean is ``near`` + a remainder below one."""
    if not len(near):
        return pa.array([], pa.int64())
    most = int(np.abs(near).max()) * n + n
    if most * most * near.shape[1] < 1 << 63:
        gap = near * n - remains.astype(np.int64)
        return pa.array((gap * gap).sum(1))
    exact = [int(s) for s in ((near.astype(object) * n - remains) ** 2).sum(1)]
    return pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())
