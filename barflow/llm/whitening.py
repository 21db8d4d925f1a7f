"""Whitening of embeddings by shifted CholeskyQR.

The entries of a vector become integers, so that counts, sums and the centring of a row
are exact. Each Gram pass is one Spark job: tasks centre their rows, divide them by the
triangular factors found so far and return one Gram matrix each, which Spark adds up. The
driver factorises d x d matrices only: the first factor is that of a shifted Gram matrix
and so exists however ill-conditioned the rows are, the later ones bring the rows to
orthonormality. The factors' product R has the singular values and right vectors of all
centred rows, and those are the components. Nothing is squared on the way to them but the
rows' own Gram matrix, whose loss the later passes repair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, ship

ship(__name__)

#: A component c becomes floor(SCALE * c) + OFFSET; what is beyond LIMIT after scaling counts as LIMIT.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 2.0**52
#: Components returned at most, Gram passes at most, and how far from the identity the last Gram matrix may be.
COMPONENTS, PASSES, SETTLED = 16, 6, 1e-12
#: Singular values below this part of the largest count as zero.
RANK = 1e-11
EPS = np.finfo(float).eps / 2


def integers(vector: Column) -> Column:
    """The integer vector of an embedding; null if the vector is null or has null or non-finite entries."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    scaled = F.transform(entries, lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c * SCALE))).cast("long") + OFFSET)
    return F.when(finite, scaled)


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they suffice, else in Python's integers."""
    largest = max(float(np.abs(x).max(initial=0)) * n, float(np.abs(sums).max(initial=0)))
    return x * n - sums if largest < 2.0**61 else x.astype(object) * n - sums.astype(object)


def squared(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where 64 bits do not hold it."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    found = (y.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in found]


@dataclass
class Basis:
    """Exact count and sums, and what turns centred rows into whitened ones."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # one unit vector a row, by falling eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int
    identity_error: float = 0.0

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows from n * x - S."""
        return (y.astype(float) / self.n) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def _totals(fit: DataFrame, sums: object, kind: str) -> dict[int, int | float]:
    """cell -> total over all tasks, where ``sums`` turns a batch's vectors into a flat array of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["cell", "value"])

    cells = fit.select("x").mapInArrow(run, f"cell long, value {kind}")
    return {r.cell: r.total for r in cells.groupBy("cell").agg(F.sum("value").alias("total")).collect()}


def moments(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows, and the sum of each dimension, both exact."""

    def sums(vectors: pa.Array) -> np.ndarray:
        x = _matrix(vectors, d)
        return np.append(x.sum(axis=0), len(x))

    found = _totals(fit, sums, "long")
    return found.get(d, 0), np.array([found.get(k, 0) for k in range(d)], np.int64)


def gram(fit: DataFrame, d: int, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after a triangular solve by each factor, added up over all tasks."""
    upper = np.triu_indices(d)

    def cells(vectors: pa.Array) -> np.ndarray:
        rows = (deviations(_matrix(vectors, d), n, sums).astype(float) / n).T
        for r in factors:
            rows = np.linalg.solve(r.T, rows)
        return (rows @ rows.T)[upper]

    found, g = _totals(fit, cells, "double"), np.zeros((d, d))
    g[upper] = [found[k] for k in range(len(upper[0]))]
    return np.triu(g) + np.triu(g, 1).T


def basis(fit: DataFrame, d: int, most: int = COMPONENTS) -> Basis | None:
    """Whitening components of distinct integer vectors (x: array<long> of length d); None if they do not vary.

    Singular directions are left out, so there may be fewer than ``most``.
    """
    n, sums = moments(fit, d)
    if n < 2:
        return None
    factors: list[np.ndarray] = []
    while True:
        g = gram(fit, d, n, sums, factors)
        if not g.any():
            return None
        if len(factors) == PASSES or factors and np.abs(g - np.eye(d)).max() <= SETTLED:
            break
        values = np.linalg.eigvalsh(g)
        shifted = not factors or values[0] < 1e-6 * values[-1]
        shift = 11 * (n * d + d * (d + 1)) * EPS * values[-1] if shifted else 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    # What the last Gram matrix still differs from the identity, or lacks in rank, goes into R.
    rest, turn = np.linalg.eigh(g)
    _, singular, right = np.linalg.svd((np.sqrt(np.maximum(rest, 0))[:, None] * turn.T) @ r)
    kept = int((singular > RANK * singular[0]).sum())
    e = singular**2 / n
    k = min(most, kept)
    found = Basis(n, sums, right[:k], e[:k], e[:k] / e.sum(), len(factors))
    found.identity_error = identity_error(fit, d, found)
    return found


def identity_error(fit: DataFrame, d: int, found: Basis) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(found.components)

    def cells(vectors: pa.Array) -> np.ndarray:
        w = found.whitened(deviations(_matrix(vectors, d), found.n, found.sums))
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    total = _totals(fit, cells, "double")
    flat = np.array([total[c] for c in range(k * k + k)]) / found.n
    mean = flat[k * k :]
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS
) -> tuple[DataFrame, Basis | None]:
    """One row per remaining vector: id, ``deviation`` and ``whitened`` (an array); and the basis.

    The basis is fitted on each distinct integer vector once and applied to all rows, so
    repeated vectors get equal results. Vectors that are null or hold null or non-finite
    entries are dropped. The commonest length of the distinct vectors is that of the table
    (of two, the greater); vectors of another length, and empty ones, have no place in it
    and are dropped too. Ids may be null or repeated. If the vectors do not vary (none, one, or all equal),
    there is no basis and no row. ``deviation`` is null where 64 bits do not hold it. Other
    columns are not read. Of eigenvectors with one eigenvalue any basis may be returned.
    """
    known = rows.select(F.col(id_col).alias("_id"), integers(F.col(vector_col)).alias("x")).filter("x is not null")
    fit = cut(known.select("x").distinct())
    try:
        sizes = fit.groupBy(F.size("x").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        d = sizes[0].d if sizes else 0
        found = basis(fit.filter(F.size("x") == d), d, most) if d else None
    finally:
        discard(fit)
    schema = T.StructType([
        T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType(), False)),
    ])
    if found is None:
        return known.limit(0).select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = deviations(_matrix(batch.column(1), d), found.n, found.sums)
            out = found.whitened(y)
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squared(y), pa.int64()), lists], schema.names)

    return known.filter(F.size("x") == d).mapInArrow(run, schema), found
