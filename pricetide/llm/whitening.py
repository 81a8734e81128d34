"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors become whole numbers x = floor(scale * c) (`vectors`). The fit list is each distinct x once. Two passes over
it give its size n, its sums S and its scatter. The scatter is taken of x - c, where c is S / n rounded to whole
numbers, so products are of centred numbers and every sum is exact; what is left of the mean (half a unit at most) is
taken off in whole-number arithmetic. Covariances thus do not depend on how rows were dealt, nor on retries.

The factor: V = L L' with L found column by column, each time at the largest diagonal entry left, until what is left
is nothing but rounding. Jacobi rotations then turn pairs of L's columns until all are orthogonal: L J = U D, hence
V = U D^2 U'. The squared norms of the turned columns are V's eigenvalues, the columns brought to length 1 are its
eigenvectors, and V itself is never rotated, which keeps small eigenvalues as accurate as large ones.

What reaches the driver: one sum per dimension and one per pair of dimensions, for any number of rows. The model goes
out with the tasks: a few numbers per dimension and component.

Edge cases: rows whose vector is null or holds a null, infinite or undefined component are left out. Null and
repeated ids are rows like others; equal vectors count once in the fit and keep a row each in the result. An empty
table, or one without a usable vector, gives no rows. Components without variance (n = 1, equal vectors, dependent
dimensions) have ``whitened`` null and ``explained`` 0 (null where nothing varies) and no part in ``identity_error``,
which is 0 if none is left. There are no more components than dimensions. Extra columns are ignored. ``deviation`` is a
decimal, as it outgrows 64 bits from some ten million vectors on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import map_arrow, materialize
from pricetide.llm.vectors import exact_products, packed, peak, unpacked, whole_numbers

SCALE = 256.0
COMPONENTS = 4

_EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """A fitted model: size, sums and rounded means of the fit list, and its leading components as columns."""

    n: int
    sums: list[int]
    centre: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of the rows' differences from the mean, each over its deviation."""
        rest = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre)])
        turned = (_less(x, self.centre).astype(np.float64) - rest) @ self.components
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, turned / np.sqrt(self.eigenvalues), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        reach = [self.n * c - s for s, c in zip(self.sums, self.centre)]  # n x - S = n (x - c) + (n c - S)
        away = _less(x, self.centre)
        most = self.n * peak(away) + max(map(abs, reach), default=0)
        kind = np.int64 if most * most * max(1, self.dims) < 1 << 63 else object
        off = away.astype(kind) * self.n + np.array(reach, kind)
        return [int(v) for v in (off * off).sum(axis=1)] if self.dims else [0] * len(x)


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    if peak(x) + max(map(abs, centre), default=0) < 1 << 63:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with L L' = v for a positive semidefinite v; as many columns as v has rank."""
    d = len(v)
    left, columns = np.diag(v).astype(np.float64).copy(), []
    floor = d * np.finfo(np.float64).eps * float(left.max(initial=0.0))
    lower = np.zeros((d, d))
    while len(columns) < d:
        pivot = int(np.argmax(left))
        if not left[pivot] > floor:
            break
        k = len(columns)
        column = (v[:, pivot] - lower[:, :k] @ lower[pivot, :k]) / np.sqrt(left[pivot])
        column[columns] = 0.0  # rows that were pivots before: zero but for rounding
        column[pivot] = np.sqrt(left[pivot])
        lower[:, k] = column
        left = np.maximum(left - column * column, 0.0)
        columns.append(pivot)
        left[columns] = 0.0
    return lower[:, :len(columns)]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times rotations that make its columns orthogonal to working precision.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that are turned together.
    """
    a, n = factor.copy(), factor.shape[1]
    if n < 2:
        return a
    ring = list(range(n)) + ([-1] if n % 2 else [])
    half, tight = len(ring) // 2, 4 * np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[:half], ring[:half - 1:-1]) if p >= 0 and q >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            apart = np.abs(xy) > tight * np.sqrt(xx * yy)
            if not apart.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(apart, np.nan_to_num(t), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            return a
    raise RuntimeError(f"columns were not orthogonal after {sweeps} sweeps")


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their eigenvectors as columns; the largest entry of each is positive."""
    turned = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((turned * turned).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = turned[:, order] / norms[order]
    if vectors.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return norms[order] ** 2, vectors


def _totals(df: DataFrame, function) -> dict[int, int]:
    """Sums by position of what the tasks give as (position, exact number): one row a position reaches the driver."""
    found = map_arrow(df, function, "position long, total decimal(38,0)").groupBy("position").agg(
        F.sum("total").cast("decimal(38,0)").alias("total"))
    return {r.position: int(r.total) for r in found.collect()}


def _exact_batch(position: list[int], total: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(position, pa.int64()), pa.array([Decimal(v) for v in total], _EXACT)],
                                      names=["position", "total"])


def fit_list(df: DataFrame, vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vector): each distinct whole-number vector once, packed. Equal ones meet in the tasks first."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], names=["vector"])

    return map_arrow(df.select(F.col(vector_col)), pack, "vector binary").distinct()


def fit(distinct: DataFrame, components: int = COMPONENTS, scale: float = SCALE) -> Whitening | None:
    """The model of a stored `fit_list`; None if it has no rows."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            x = unpacked(batch.column(0))
            n += len(x)
            part = np.zeros(max(x.shape[1], len(total)), object)
            part[:len(total)] += total
            part[:x.shape[1]] += x.sum(axis=0) if peak(x) * max(1, len(x)) < 1 << 63 else x.astype(object).sum(axis=0)
            total = part
        yield _exact_batch([-1, *range(len(total))], [n, *total.tolist()])

    found = _totals(distinct, sums)
    n = found.pop(-1, 0)
    if not n:
        return None
    dims = max(found, default=-1) + 1
    total = [found[k] for k in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    above = np.triu_indices(dims)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((dims, dims), object)
        for batch in batches:
            z = _less(unpacked(batch.column(0), dims), centre)
            made = made + exact_products(z.T, z, peak(z) ** 2 * len(z)).astype(object)
        yield _exact_batch((above[0] * dims + above[1]).tolist(), made[above].tolist())

    products = _totals(distinct, scatter) if dims else {}
    rest = [s - n * c for s, c in zip(total, centre)]
    v = np.zeros((dims, dims))
    for i, j in zip(*above):
        v[i, j] = v[j, i] = (n * products[int(i * dims + j)] - rest[i] * rest[j]) / (n * n)
    values, vectors = eigen(v)
    k = min(components, dims)
    axes, kept = np.zeros((dims, k)), min(k, len(values))
    axes[:, :kept] = vectors[:, :kept]
    return Whitening(n, total, centre, axes, np.concatenate([values[:kept], np.zeros(k - kept)]), float(np.trace(v)), scale)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by a pass over the list."""
    k = int((model.eigenvalues > 0).sum())
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(unpacked(batch.column(0), model.dims))[:, :k]
            made += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int64()), pa.array(made.ravel())],
                                         names=["position", "total"])

    found = map_arrow(distinct, moments, "position long, total double").groupBy("position").agg(F.sum("total").alias("total"))
    made = np.zeros((k + 1) * k)
    for r in found.collect():  # (k + 1) k rows
        made[r.position] = r.total
    made = made.reshape(k + 1, k) / model.n
    return float(np.abs(made[:k] - np.outer(made[k], made[k]) - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, deviation, whitened, explained): each row that takes part, once per component."""
    kind = df.schema[id_col].dataType.simpleString()
    k, positive = len(model.eigenvalues), model.eigenvalues > 0
    explained = (model.eigenvalues / model.trace if model.trace else np.full(k, np.nan))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1), model.scale):
                wide = np.zeros((len(x), model.dims), np.int64)
                wide[:, :min(x.shape[1], model.dims)] = x[:, :model.dims]
                w, off = model.whitened(wide), model.deviations(wide)
                times = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows[times])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array([Decimal(v) for v in off], _EXACT).take(pa.array(times)),
                    pa.array(w.ravel(), mask=np.tile(~positive, len(rows))),
                    pa.array(np.tile(explained, len(rows)), mask=np.tile(np.isnan(explained), len(rows))),
                ], names=["id", "component", "deviation", "whitened", "explained"])

    made = map_arrow(df.select(F.col(id_col), F.col(vector_col)), turn,
                     f"id {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return made.withColumnRenamed("id", id_col)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: float = SCALE) -> DataFrame:
    """`transform` by the model of the table itself, with ``n`` and ``identity_error`` as columns."""
    distinct = materialize(fit_list(df, vector_col, scale))
    model = fit(distinct, components, scale)
    if model is None:
        model = Whitening(0, [], [], np.zeros((0, 0)), np.zeros(0), 0.0, scale)
    error = identity_error(distinct, model)
    return transform(df, model, id_col, vector_col).withColumns(
        {"n": F.lit(model.n).cast("long"), "identity_error": F.lit(error)})
