"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed from outside: each Spark pass sends a block Q of orthonormal columns to the rows of the fit
list and brings back Xt(XQ) of the centred rows, which the tasks sum in two rounds, so the driver gets a few blocks of
dimensions x block width, whatever the table. The driver takes the Rayleigh-Ritz values and vectors of the product, their
residuals, and the next block by QR. It ends when the residuals certify all components. Where the spectrum is so flat that
the expected number of passes is over ``PATIENCE``, the block is widened with fresh directions, up to the whole dimension, where one
more pass is exact; so the number of passes has a bound for any table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

COMPONENTS = 16
#: Columns of the first block.
WIDTH = 2 * COMPONENTS
#: Residuals that certify a component, over the largest eigenvalue.
TOLERANCE = 1e-13
#: Further passes that a block may be expected to take; beyond them it is widened.
PATIENCE = 4
SCALE, SHIFT = 64, 1_000_000
#: Entries of larger size do not fit the whole numbers that sums are exact in; their rows are dropped like non-finite ones.
LARGEST = 2.0**40
SEED = 11
#: Tasks of the second round of sums.
SECOND = 16


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vec: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers in range."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(LARGEST)))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vec) > 0)


def whole(vec: Column) -> Column:
    """Entries as whole numbers: floor(64 c) + 1,000,000."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def rows_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows. Of vectors of several lengths those of the most frequent length stay, of equally frequent
    ones the longest."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("_v")).filter(usable(F.col("_v")))
    sizes = own.groupBy(F.size("_v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    kept = own.filter(F.size("_v") == (sizes["d"] if sizes else 0))
    return kept.select("vec_id", whole(F.col("_v")).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once; copies combine before the shuffle."""
    return rows.select("x").distinct()


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch of vectors as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, size: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum of what ``add(total, X)`` adds to a vector of ``size`` numbers for each batch of rows X: by task, then by groups of
    tasks, then those few on the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                add(total, _matrix(batch.column(0), d))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            for b in batch.column(0):
                seen = True
                total += np.frombuffer(b.as_buffer())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.select("x").mapInArrow(first, "total binary").repartition(SECOND).mapInArrow(second, "total binary").collect()
    return np.sum([np.frombuffer(r["total"]) for r in parts], axis=0) if parts else np.zeros(size)


def product(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V Q, trace V) times the number of rows: one pass."""
    d, p = q.shape

    def add(total: np.ndarray, x: np.ndarray) -> None:
        c = x - mean
        total[:-1] += (c.T @ (c @ q)).ravel()
        total[-1] += np.square(c).sum()

    out = summed(rows, d, d * p + 1, add)
    return out[:-1].reshape(d, p), float(out[-1])


def _widened(q: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that begin with the span of ``q``, ``width`` in all."""
    d = q.shape[0]
    more = rng.standard_normal((d, width - q.shape[1]))
    return np.linalg.qr(np.hstack([q, more]))[0]


def passes_left(values: np.ndarray, worst: float, k: int) -> float:
    """Passes that the block is expected to take: each one shrinks an error by the eigenvalue beyond the block over the k-th one,
    of which the block's smallest Ritz value is a bound from below."""
    if worst <= TOLERANCE:
        return 0.0
    rate = max(values[-1], 0.0) / values[k - 1] if values[k - 1] > 0 else 0.0
    return math.inf if rate >= 1 else math.log(worst / TOLERANCE) / -math.log(rate) if rate > 0 else 1.0


def subspace_iteration(rows: DataFrame, mean: np.ndarray, n: int, k: int, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, int]:
    """(eigenvalues, eigenvectors, trace, residuals, passes) of the ``k`` largest components of the covariance of ``rows`` (x)."""
    d = len(mean)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, width))))[0]
    passes = 0
    while True:
        y, trace = product(rows, mean, q)
        y, trace, passes = y / n, trace / n, passes + 1
        t = q.T @ y
        values, u = np.linalg.eigh((t + t.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        vectors, image = q @ u, y @ u
        residuals = np.linalg.norm(image - vectors * values, axis=0)
        scale = max(values[0], np.finfo(float).tiny)
        worst = float(residuals[:k].max()) / scale
        if worst <= TOLERANCE or q.shape[1] == d:
            # a block of all dimensions spans the whole space: what is left is rounding
            return values[:k], vectors[:, :k], trace, residuals[:k] / scale, passes
        basis = np.linalg.qr(image)[0]
        if passes > 1 and passes_left(values, worst, k) > PATIENCE:
            basis = _widened(basis, min(d, 2 * q.shape[1]), rng)
        q = basis


def fitted(fit: DataFrame, k: int = COMPONENTS, width: int = WIDTH) -> Fit | None:
    """The whitening of a stored fit list; None for an empty one. Components without variance are left out."""
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n, s = sums[0]["n"], [r["s"] for r in sums]
    mean = np.array([v / n for v in s])
    values, vectors, trace, residuals, passes = subspace_iteration(fit, mean, n, min(k, len(s)), width)
    there = values > max(values[0], 0.0) * len(s) * np.finfo(float).eps * 16
    values, vectors, residuals = values[there], vectors[:, there], residuals[there]
    m = len(values)
    w = vectors / np.sqrt(values)

    def add(total: np.ndarray, x: np.ndarray) -> None:
        z = (x - mean) @ w
        total[: m * m] += (z.T @ z).ravel()
        total[m * m :] += z.sum(0)

    out = summed(fit, len(s), m * m + m, add) / n if m else np.zeros(0)
    centre = out[m * m :]
    error = np.abs(out[: m * m].reshape(m, m) - np.outer(centre, centre) - np.eye(m)).max() if m else 0.0
    return Fit(n, s, values, vectors, trace, residuals, float(error), passes)


def applied(rows: DataFrame, fit: Fit | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row (vec_id, x) and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], schema)
    d, m = len(fit.sums), len(fit.values)
    n, sums, mean, w, explained, error = fit.n, np.array(fit.sums, np.int64), fit.mean, fit.vectors / np.sqrt(fit.values), fit.values / fit.trace, fit.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows_ = _matrix(batch.column(1), d), batch.num_rows
            away = n * x - sums
            if float(np.abs(away).max()) ** 2 * d >= 2.0**63:
                raise OverflowError("deviation beyond 64 bits")
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows_), m)))
            cols = [np.tile(np.arange(1, m + 1, dtype=np.int32), rows_), np.full(rows_ * m, n), np.repeat((away * away).sum(1), m), ((x - mean) @ w).ravel(), np.tile(explained, rows_), np.full(rows_ * m, error)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of up to ``k``
    components, numbered from 1 by falling eigenvalue; copies of a vector count once in the fit and are each in the result.

    Nulls: rows whose vector is null, empty, or holds a null, a non-finite or an out-of-range entry are dropped, as are vectors of
    another length than most; a null id stays. Repeated rows are given each. Of equal eigenvalues the vectors are any basis.
    Components without variance are left out, so a table of one distinct vector, like an empty one, gives no rows. Only id and
    vector are read, so other names cannot clash.
    """
    rows = rows_of(vectors, id_col, vec_col)
    return applied(rows, fitted(stored(fit_list(rows), "fit"), k, width))


def op11_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_subspace_whitening": op11_subspace_whitening}
ORACLE: dict[str, str] = {}
