"""Embedding whitening against numpy's eigenvectors of the same covariance."""

import math

import numpy as np
import pytest

from barflow.llm import queries as registered
from barflow.llm import whitening
from barflow.llm.common import table

INF, NAN = float("inf"), float("nan")


def expected(vectors):
    """Whitened rows, deviations, eigenvalues and n by plain numpy."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    return ((n * x - sums) / n) @ turn / np.sqrt(np.maximum(values, 1e-30)), ((n * x - sums) ** 2).sum(axis=1), values, n


def test_query_equals_numpy(spark, sf_dir):
    rows = registered.QUERIES["op11_embedding_whitening"](spark, sf_dir).toPandas()
    given = table(spark, sf_dir, "embeddings").collect()
    white, deviation, values, n = expected([r["embedding"] for r in given])
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in given]].to_numpy()
    assert wide.shape[1] == 16 and set(rows["n"]) == {n}
    np.testing.assert_allclose(np.abs(wide), np.abs(white[:, :16]), atol=1e-8)
    first = rows[rows["component"] == 1].set_index("vec_id").loc[[r["vec_id"] for r in given]]
    assert first["deviation"].tolist() == deviation.tolist()
    np.testing.assert_allclose(rows.groupby("component")["explained"].first(), values[:16] / values.sum(), rtol=1e-8)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-10


def test_rows_that_are_dropped_repeated_or_ill_conditioned(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6)) * [1000, 30, 3, 1, 0, 0]
    base[:, 5] = base[:, 0]  # one dimension is constant, one a copy
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(7, base[7].tolist())] * 200
    odd = [(900, None), (901, [1.0] * 5 + [None]), (902, [NAN] * 6), (903, [0.0] * 5 + [-INF]), (904, [1.0]), (905, []), (None, base[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as _id", "3 as cell")
    out, basis = whitening.whiten(df)
    got = out.collect()
    white, deviation, values, n = expected([v for _, v in rows])
    assert basis.n == n == 300 and len(basis.components) == 4 and basis.identity_error < 1e-8
    assert len(got) == 501 and [r["vec_id"] for r in got].count(None) == 1
    of = {r["vec_id"]: r for r in got}
    for k in (0, 7, 299):
        np.testing.assert_allclose(np.abs(of[k]["whitened"]), np.abs(white[k, :4]), atol=1e-6)
        assert of[k]["deviation"] == deviation[k]
    np.testing.assert_allclose(basis.explained, values[:4] / values.sum(), rtol=1e-8)
    assert sum(r["vec_id"] == 7 for r in got) == 201


def test_small_eigenvalues_keep_their_digits(spark):
    """A Gram matrix alone would lose what lies ten digits under the largest direction."""
    rng = np.random.default_rng(9)
    scale = np.array([2.0**40, 2.0**20, 1.0])
    ints = np.round(rng.normal(size=(400, 3)) * scale * 64)
    df = spark.createDataFrame([(k, (v / 64).tolist()) for k, v in enumerate(ints)], "vec_id long, embedding array<double>")
    _, basis = whitening.whiten(df)
    centred = ints - ints.mean(axis=0)
    _, s, _ = np.linalg.svd(centred / np.sqrt(400), full_matrices=False)
    assert len(basis.eigenvalues) == 2 or basis.eigenvalues[2] / s[2] ** 2 == pytest.approx(1, rel=1e-2)
    np.testing.assert_allclose(basis.eigenvalues[:2], s[:2] ** 2, rtol=1e-6)
    assert basis.identity_error < 1e-4


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0], [1.001, 2.0]], [None]])
def test_tables_that_do_not_vary_have_no_rows(spark, vectors):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out, basis = whitening.whiten(df)
    assert basis is None and out.collect() == [] and out.columns == ["vec_id", "deviation", "whitened"]


def test_numbers_beyond_64_bits_are_exact_or_null(spark):
    df = spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [0.0])], "vec_id long, embedding array<double>")
    out, _ = whitening.whiten(df)
    got = {r["vec_id"]: r["deviation"] for r in out.collect()}
    assert got[1] is None and got[2] is None and math.isfinite(got[3])
    assert whitening.squared(np.array([[2**40, 0], [2**30, 1]], np.int64)) == [None, 2**60 + 1]
