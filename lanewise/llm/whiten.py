"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers first, so that sums and the scatter are exact whatever the order in which tasks finish. Tasks hand over sums of
one row per dimension, or pair of dimensions; only those, whose number does not depend on the rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps per unit and shift of the integers that entries become: x = floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 1024, 100_000
#: Entries beyond this are no vector to whiten: their integers would not be exact as doubles.
MOST = float(2**42)
#: Components that are returned.
COMPONENTS = 8
#: Rows that are worked on at once.
ROWS = 2_048

WIDE = "decimal(38,0)"


def usable(vector: Column) -> Column:
    """A vector that is not null, not empty, and has only finite entries under ``MOST``."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= MOST))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of a batch as integers in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(STEPS * flat) + SHIFT


def _wide(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _add_up(vectors: DataFrame, dim: int, measure, pairs: bool) -> dict:
    """Sums over all rows of what ``measure`` (rows as integers in doubles) gives: exact, by dimension or by pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), dim)
                part = measure(x)
                total, n = part if total is None else total + part, n + len(x)
        if total is not None:
            at = [(i, j) for i in range(dim) for j in range(i, dim)] if pairs else [(i, i) for i in range(dim)]
            values = [int(total[i, j]) for i, j in at] if pairs else [int(v) for v in total]
            a, b = (pa.array(side, pa.int32()) for side in zip(*at, strict=True))
            yield pa.RecordBatch.from_arrays([a, b, _wide(values), pa.array([n] * len(at), pa.int64())], names=["a", "b", "v", "n"])

    sums = vectors.mapInArrow(run, f"a int, b int, v {WIDE}, n long").groupBy("a", "b").agg(F.sum("v").cast(WIDE).alias("v"), F.sum("n").alias("n"))
    return {(r["a"], r["b"]): (int(r["v"]), r["n"]) for r in sums.collect()}


def _exact(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    return x.astype(np.int64).astype(object).sum(axis=0) if x.size and np.abs(x).max() * len(x) >= 2**53 else x.sum(axis=0).astype(object)


def _gram(centre: np.ndarray):
    def measure(x: np.ndarray) -> np.ndarray:
        r = x - centre
        most = np.abs(r).max(initial=0.0)
        if most * most * len(r) < 2**53:  # every partial sum is an integer that a double holds
            return np.vectorize(int, otypes=[object])(r.T @ r)
        own = r.astype(np.int64).astype(object)
        return own.T @ own

    return measure


def pivoted_cholesky(matrix: np.ndarray, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """``L`` (lower triangular, as many columns as the rank) and the order of rows: ``matrix[order][:, order] = L @ L.T``.

    The largest diagonal entry left is the next pivot; it ends where that falls under ``tolerance`` of the first, times the size.
    """
    a, size = np.array(matrix, np.float64), len(matrix)
    order, out = np.arange(size), np.zeros((size, size))
    first, rank = max(a.diagonal().max(initial=0.0), 0.0), 0
    for k in range(size):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= tolerance * size * first or first == 0.0:
            break
        for m in (a, out):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        out[k, k] = np.sqrt(a[k, k])
        out[k + 1 :, k] = a[k + 1 :, k] / out[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
        rank += 1
    return out[:, :rank], order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until they are orthogonal.

    A round takes every column once, in disjoint pairs; the rounds of a sweep meet all pairs.
    """
    g = np.array(factor, np.float64)
    n = g.shape[1]
    if n < 2:
        return g
    ring = list(range(n)) + ([-1] if n % 2 else [])
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            met = [(i, j) for i, j in zip(ring[:half], reversed(ring[half:]), strict=True) if i >= 0 and j >= 0]
            i, j = np.array(met).T
            x, y = g[:, i], g[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, float(off.max()))
            turn = off > 1e-17
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * x - c * t * y, c * t * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst < 1e-15:
            return g
    return g


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: size of the fit list, sums by dimension, components in columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def common_dimension(vectors: DataFrame, column: str) -> int:
    """The dimension that most usable vectors have, the larger one of equals; 0 without vectors."""
    sizes = vectors.where(usable(F.col(column))).groupBy(F.size(column).alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.col("rows").desc(), F.col("dim").desc()).limit(1).collect()
    return most[0]["dim"] if most else 0


def _fit_list(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    return vectors.where(usable(F.col(column)) & (F.size(column) == dim))


def fit(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable vectors of the common dimension; null without any.

    Four reads of the column: dimension, sums, scatter about the mean rounded to integers (the rest of the mean is taken off exactly), and the covariance of what
    comes out. Directions without variance are no components.
    """
    dim = common_dimension(vectors, column)
    if not dim:
        return None
    rows = _fit_list(vectors, column, dim).select(column)
    first = _add_up(rows, dim, _exact, pairs=False)
    n, sums = first[0, 0][1], [first[i, i][0] for i in range(dim)]
    centre = [round(Fraction(s, n)) for s in sums]
    about = _add_up(rows, dim, _gram(np.array(centre, np.float64)), pairs=True)
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    cov = np.zeros((dim, dim))
    for (i, j), (v, _) in about.items():
        cov[i, j] = cov[j, i] = float(Fraction(n * v - left[i] * left[j], n * n))
    factor, order = pivoted_cholesky(cov)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    able = np.argsort(-norms, kind="stable")
    able = able[norms[able] > 0][:most]
    parts = np.zeros((dim, len(able)))
    parts[order] = turned[:, able] / norms[able]
    for k in range(len(able)):  # either sign is right: the largest entry is positive, so that reruns agree
        parts[:, k] *= np.sign(parts[np.argmax(np.abs(parts[:, k])), k])
    model = Whitening(n, tuple(sums), parts, norms[able] ** 2, float(np.trace(cov)))
    return Whitening(*list(model.__dict__.values())[:5], identity_error=_identity_error(rows, dim, model))


def _whiten(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows on the components: the exact mean is taken off in two steps, whole and rest, so that large means cost no digits."""
    whole = np.array([s // model.n for s in model.sums], np.float64)
    rest = np.array([float(Fraction(s % model.n, model.n)) for s in model.sums])
    return ((x - whole) - rest) @ model.components / np.sqrt(model.eigenvalues)


def _identity_error(rows: DataFrame, dim: int, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, total, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = _whiten(_matrix(batch.column(0).slice(at, ROWS), dim), model)
                outer, total, n = outer + w.T @ w, total + w.sum(axis=0), n + len(w)
        if n:
            cells = [(i, j, float(outer[i, j])) for i in range(k) for j in range(k)] + [(i, -1, float(total[i])) for i in range(k)]
            a, b, v = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.float64())], names=["a", "b", "v"])

    if not k:
        return 0.0
    sums = {(r["a"], r["b"]): r["v"] for r in rows.mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([sums[i, -1] for i in range(k)]) / model.n
    cov = np.array([[sums[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, exact; null where it does not fit a long. Vectors that ``fit`` leaves out give no row, neither does a
    table without variance. Repeated rows and null keys are rows of their own.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    dim, k = model.components.shape
    whole, rest = np.array([s // model.n for s in model.sums], np.float64), [s % model.n for s in model.sums]
    shares = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(1).slice(at, ROWS), dim)
                w = _whiten(x, model)
                far = _deviations(x - whole, rest, model.n)
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, ROWS).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return _fit_list(vectors, column, dim).select(key, column).mapInArrow(run, schema)


def _deviations(r: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sums of (n * r - rest)^2 by row, exact."""
    most = (np.abs(r).max(initial=0.0) + 1) * n
    if most * most * r.shape[1] < 2**62:
        d = n * r.astype(np.int64) - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = n * r.astype(np.int64).astype(object) - np.array(rest, object)
    return [v if v < 2**63 else None for v in (exact * exact).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Fit on all usable vectors and whiten each of them."""
    return transform(vectors, fit(vectors, column, most), key, column)
