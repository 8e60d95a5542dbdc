from __future__ import annotations

import numpy as np
import pytest

from qloom.llm import suite, whitening
from qloom.llm.common import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def brute(vectors):
    """x, S, and the covariance's eigenvalues, with whole numbers and a library's solver."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(d) for d in ((n * x - sums) ** 2).sum(1)]
    z = ((n * x - sums) / n).astype(float)
    values, components = np.linalg.eigh(z.T @ z / n)
    return n, deviation, z, values[::-1], components[:, ::-1]


def test_query_equals_brute_force(spark):
    held = read_table(spark, SF, "embeddings").orderBy("vec_id").collect()
    rows = suite.QUERIES["op11_whiten_embeddings"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    n, deviation, z, values, components = brute([r.embedding for r in held])
    white = rows.whitened.to_numpy().reshape(n, 32)
    assert (rows.n == n).all() and rows.deviation.to_numpy().reshape(n, 32)[:, 0].tolist() == deviation
    expected = z @ components[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(white) - np.abs(expected)).max() < 1e-9
    assert np.allclose(rows.explained.to_numpy()[:32], values[:32] / values.sum(), rtol=1e-10)
    error = np.abs(white.T @ white / n - np.eye(32)).max()
    assert rows.identity_error.nunique() == 1 and error < 1e-10 and rows.identity_error[0] < 1e-10


@pytest.mark.parametrize("width, rank", [(1, 1), (7, 7), (40, 12), (128, 128)])
def test_factor_and_rotation(width, rank):
    rng = np.random.default_rng(width)
    rows = rng.normal(size=(300, rank)) @ (rng.normal(size=(rank, width)) * np.logspace(0, -3, width))
    scatter = rows.T @ rows
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, scatter, atol=1e-10 * scatter.max())
    rotated = whitening.one_sided_jacobi(factor)
    norms = np.sqrt((rotated**2).sum(0))
    assert np.abs((rotated / norms).T @ (rotated / norms) - np.eye(rank)).max() < 1e-13
    assert np.allclose(np.sort(norms**2), np.linalg.eigvalsh(scatter)[-rank:], atol=1e-11 * scatter.max())


def test_left_out_repeated_and_clashing(spark):
    rng = np.random.default_rng(5)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(40, 6))]
    bad = [None, [], [1.0] * 5 + [None], [float("nan")] + [1.0] * 5, [float("inf")] * 6]
    data = [(k, v, None, 3, "x") for k, v in enumerate(good)] + [(k, v, 1, 2, None) for k, v in enumerate(bad)]
    data += [(None, good[0], None, None, None), (0, good[0], None, None, None)]
    found = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(5)).toPandas()
    n, deviation, z, values, _ = brute([*good, good[0], good[0]])
    assert len(found) == 42 * 6 and (found.n == 42).all() and found.vec_id.isna().sum() == 6
    assert sorted(found[found.component == 1].deviation) == sorted(deviation)
    assert found.identity_error.max() < 1e-10
    one = found[found.component == 1].sort_values("vec_id")
    assert one.whitened[one.vec_id == 0].nunique() == 1


def test_no_scatter_and_no_rows(spark):
    same = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.filter("false")).columns == [
        *("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    ]


def test_ties_and_a_constant_dimension(spark):
    data = [(k, [float(a), float(b), 7.0]) for k, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    found = whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).toPandas()
    assert len(found) == 8 and np.allclose(found.explained, 0.5) and found.identity_error[0] < 1e-12


def test_widths_and_size_of_entries(spark):
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="different widths"):
        whitening.whiten(mixed.coalesce(1)).count()
    huge = spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="whole number"):
        whitening.whiten(huge).count()
    wide = spark.createDataFrame([(1, [1e11]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(wide).collect()] == [None, None]
