"""Whitening of embeddings: principal components by mixed-precision refinement of a distributed covariance.

Entries become integers, so that sums over all vectors are exact whatever the order of tasks. Spark sums the
distinct vectors, then the products of their differences from the nearest whole mean; both are whole numbers, and the
covariance follows from them without loss. Only the matrix of d x d sums comes to the driver. Its eigenvectors are
computed in float32 and corrected by iterations of matrix products in extended precision (Ogita and Aishima, 2018):
with R = I - X'X and S = X'AX, the correction E has (S_ij + l_j R_ij) / (l_j - l_i) where two eigenvalues are further apart than
the error bound, else R_ij / 2. Vectors of eigenvalues that are too near to each other are turned within their own
space by the eigenvectors of the small matrix X_J'(A - mean)X_J, after which they are told apart (Ogita and Aishima, 2019).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
#: Rows whose integers are multiplied at once; fewer where products could leave the whole numbers that a double holds.
BLOCK = 4_096
_EXACT = 2**53
#: Most corrections of the eigenvectors; four or five suffice from float32 to extended precision.
MOST_STEPS = 40


def integers(vec: Column) -> Column:
    """floor(SCALE * c) of each entry as a long; beyond a long's range the nearest long."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE))


def usable(vec: Column) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _product(a: np.ndarray) -> np.ndarray:
    """a'a of whole numbers, exact: by doubles where every sum fits one, else by Python's integers."""
    most = int(np.abs(a).max(initial=0)) if a.dtype != object else _EXACT
    if most * most * max(1, len(a)) < _EXACT:
        return (a.astype(np.float64).T @ a.astype(np.float64)).astype(np.int64).astype(object)
    wide = a.astype(object)
    return wide.T @ wide


def _less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift in integers, as Python's where 64 bits may be too few."""
    if np.abs(x.astype(float)).max(initial=0.0) + np.abs(shift.astype(float)).max(initial=0.0) < 2.0**62:
        return x - shift.astype(np.int64)
    return x.astype(object) - shift


def _summed(distinct: DataFrame, per_task: Callable[[np.ndarray], np.ndarray], d: int) -> dict[tuple[int, int], int]:
    """The sums over all rows of the whole numbers (i, j, v) that each task makes of its rows; at most d x d come to the driver."""
    wide = pa.decimal128(38)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", wide), ("low", wide)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = per_task(_matrix(batch.column(0).slice(at, BLOCK), d))
                total = part if total is None else total + part
        if total is not None:
            rows, cols = np.triu_indices(d) if total.ndim == 2 else (np.zeros(d, int), np.arange(d))
            values = [int(v) for v in (total[rows, cols] if total.ndim == 2 else total)]
            parts = [[Decimal(v >> 64) for v in values], [Decimal(v & (2**64 - 1)) for v in values]]  # products of two longs exceed 38 digits
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), *(pa.array(p, wide) for p in parts)], schema=schema)

    sums = distinct.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r.i, r.j): (int(r.high) << 64) + int(r.low) for r in sums.collect()}


@dataclass
class Whitening:
    """n distinct vectors with sums ``sums``; unit eigenvectors as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # d x k
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def d(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors; nan along components without variance."""
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (_less(x, whole).astype(np.float64) - rest) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it exceeds a long."""
        most = float(np.abs(x.astype(float)).max(initial=0.0)) * self.n + max(map(abs, self.sums), default=0)
        if most * most * self.d < 2.0**62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from approximate vectors, to the precision of ``a``'s type."""
    eye, size = np.eye(len(a), dtype=a.dtype), np.abs(a).sum(axis=1).max(initial=0)
    eps = np.finfo(a.dtype).eps
    noise = 4 * len(a) * eps * size  # what rounding alone may leave in a product
    lam, before = np.diagonal(x.T @ a @ x).copy(), np.inf
    for _ in range(MOST_STEPS if size > 0 else 0):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, divided by a small gap, would tilt vectors against each other
        lam = np.diagonal(s) / (1 - np.diagonal(r))
        off = s - np.diag(np.diagonal(s))
        bound = 2 * (np.sqrt((off**2).sum()) + size * np.sqrt((r**2).sum())) + noise
        gap = lam[None, :] - lam[:, None]
        far = np.abs(gap) > bound
        e = np.where(far, (s + lam[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        moved = np.abs(e).max()
        near = _clusters(lam, bound)
        for own in near:
            x[:, own] = _turned(a, x[:, own], noise)
        if moved <= 16 * eps or (moved < 1e-3 and 2 * moved >= before):  # vectors of a gap g can't be had beyond rounding / g
            break
        before = moved
    for _ in range(2 if size > 0 else 0):  # such remainders leave vectors of near eigenvalues a little oblique
        x = x + x @ ((eye - x.T @ x) / 2)
        lam = np.diagonal(x.T @ (a @ x)).copy()
    norm = np.sqrt((x**2).sum(axis=0))
    return lam, x / np.where(norm > 0, norm, 1)


def _clusters(lam: np.ndarray, bound: float) -> list[np.ndarray]:
    """Sets of two or more eigenvalues, each within the bound of its next."""
    order = np.argsort(lam)
    cut = np.flatnonzero(np.diff(lam[order]) > bound) + 1
    return [own for own in np.split(order, cut) if len(own) > 1]


def _turned(a: np.ndarray, x: np.ndarray, noise: float) -> np.ndarray:
    """The vectors of a cluster, turned within their space by the small problem without the eigenvalues' common part.

    A problem within rounding is of equal eigenvalues: any basis of the space will do.
    """
    mu = (x * (a @ x)).sum() / (x * x).sum()
    t = x.T @ (a @ x - mu * x)
    t = (t + t.T) / 2
    scale = np.abs(t).max()
    return x @ np.linalg.eigh((t / scale).astype(np.float64))[1].astype(a.dtype) if np.abs(t - np.diag(np.diagonal(t))).max() > noise else x


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of an extended-precision symmetric matrix.

    float32 gives the start. The largest entry of each vector is positive, so that a fit gives the same signs each time.
    """
    scale = np.abs(cov).max(initial=0)
    low = (cov / scale if scale > 0 else cov).astype(np.float32)
    lam, x = refine(cov / scale if scale > 0 else cov, np.linalg.eigh(low)[1].astype(cov.dtype))
    order = np.argsort(-lam, kind="stable")
    lam, x = lam[order] * (scale if scale > 0 else 1), x[:, order]
    return lam, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)


def fit(rows: DataFrame, vec_col: str = "embedding", components: int | None = None, d: int | None = None) -> Whitening | None:
    """Fit on each distinct integer vector of ``rows`` once; None without any.

    Vectors of another length than ``d`` (the commonest if it isn't given, of equally common ones the smallest) take no part.
    The distinct vectors are stored, as three passes read them. Repeats are gathered in each task before the
    shuffle, so that a vector that a third of the rows share costs a row a task.
    """
    good = rows.select(F.col(vec_col).alias("v")).where(usable(F.col("v")))
    if d is None:
        sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        d = sizes[0].d if sizes else 0
    if not d:
        return None
    distinct = materialize(good.where(F.size("v") == d).select(integers(F.col("v")).alias("x")).groupBy("x").agg(F.lit(True).alias("one")).select("x"), "distinct-vectors")
    n = distinct.count()
    if not n:
        return None
    sums = _summed(distinct, lambda x: x.astype(object).sum(axis=0) if np.abs(x.astype(float)).max(initial=0) > 2**40 else x.sum(axis=0).astype(object), d)
    total = [sums.get((0, j), 0) for j in range(d)]
    middle = np.array([(2 * s + n) // (2 * n) for s in total], object)  # the whole number nearest to the mean
    products = _summed(distinct, lambda x: _product(_less(x, middle)), d)
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    cov = np.zeros((d, d), np.longdouble)
    for (i, j), v in products.items():
        cov[i, j] = cov[j, i] = _ratio(n * v - rest[i] * rest[j], n * n)
    values, vectors = eigen(cov)
    floor = float(np.abs(values).max(initial=0)) * d * np.finfo(np.longdouble).eps * 64
    values = np.where(values > floor, values, 0).astype(np.float64)
    k = min(components or d, d)
    found = Whitening(n, total, np.ascontiguousarray(vectors[:, :k].astype(np.float64)), values[:k], float(np.trace(cov)))
    found.identity_error = _identity_error(distinct, found)
    return found


def _ratio(a: int, b: int) -> np.longdouble:
    """a / b in extended precision, whatever their size."""
    shift = max(0, 80 - a.bit_length() + b.bit_length()) if a else 0
    return np.ldexp(np.longdouble((a << shift) // b), -shift)


def _identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the difference of the whitened vectors' covariance from the identity, over components with variance."""
    k, d = len(fitted.values), fitted.d
    live = np.flatnonzero(fitted.values > 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w = np.nan_to_num(fitted.project(_matrix(batch.column(0).slice(at, BLOCK), d)))
                total, first = total + w.T @ w, first + w.sum(axis=0)
        both = np.concatenate([total, first[None, :]])
        i, j = np.divmod(np.arange(both.size), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both.ravel())], names=["i", "j", "v"])

    got = distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((k + 1, k))
    for r in got:
        sums[r.i, r.j] = r.v
    mean = sums[k] / fitted.n
    cov = sums[:k] / fitted.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max(initial=0.0))


def whiten(rows: DataFrame, fitted: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding", components: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component from 1.

    Rows whose vector is null, holds null or non-finite entries, or is of another length than the fitted ones give none;
    null ids and repeated rows are kept. Along a component without variance whitened is null and explained 0; deviation is
    null where it exceeds a long. Without a fit (no usable vector) there are no rows.
    """
    out = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v")))
    if fitted is None:
        return good.where(F.lit(False)).selectExpr("id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    k = min(components or len(fitted.values), len(fitted.values))
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        share = own.values / own.trace if own.trace > 0 else np.zeros(len(own.values))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), own.d)
                w = own.project(x)[:, :k].ravel()
                m = part.num_rows
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, own.n, np.int64)),
                        pa.array(own.deviations(x), pa.int64()).take(row),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(share[:k], m)),
                        pa.array(np.full(m * k, own.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return good.where(F.size("v") == fitted.d).select("id", integers(F.col("v")).alias("x")).mapInArrow(run, out)
