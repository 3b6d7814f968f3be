"""Whitening of embeddings: pivoted Cholesky of the scatter, then one-sided Jacobi.

The fit list is each distinct vector once. Tasks centre its vectors before they multiply
them, and their sums make the covariance, a matrix whose size the vectors' width gives and
not their number. Its Cholesky factor, with the largest pivot first, is triangular; Jacobi
rotations of its columns make them orthogonal without forming the covariance again. Then
the columns' squared norms are the eigenvalues, and the columns over their norms the
components. Pivoting brings the columns close to falling norms, so few sweeps suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import free_name, stored

SCALE = 256
COMPONENTS = 4
#: Pivots and eigenvalues below this part of the largest count as zero.
RANK_TOLERANCE = 1e-13
#: Columns whose cosine is below this are orthogonal.
ANGLE_TOLERANCE = 1e-15
SWEEPS = 60
_LONG = (1 << 63) - 1


def pivoted_cholesky(matrix: np.ndarray, tolerance: float = RANK_TOLERANCE) -> np.ndarray:
    """L of as many columns as the rank, with L @ L.T the matrix.

    Each column takes the largest diagonal entry that is left; its rows are in the
    matrix's own order, so L is triangular up to the order of the pivots.
    """
    rest = np.array(matrix, float)
    columns: list[np.ndarray] = []
    largest = rest.diagonal().max(initial=0.0)
    taken = np.zeros(len(rest), bool)
    for _ in range(len(rest)):
        left = np.where(taken, -np.inf, rest.diagonal())
        k = int(left.argmax())
        if not left[k] > tolerance * largest:
            break
        column = rest[:, k] / np.sqrt(rest[k, k])
        column[taken] = 0.0
        rest -= np.outer(column, column)
        taken[k] = True
        columns.append(column)
    return np.stack(columns, axis=1) if columns else np.zeros((len(rest), 0))


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs below n in rounds of pairs without a common member, as a tournament has them."""
    seats = list(range(n + n % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], seats[::-1]) if max(a, b) < n]
        rounds.append(tuple(np.array(side) for side in zip(*pairs)) if pairs else (np.empty(0, int),) * 2)
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of factor @ factor.T, by falling eigenvalue.

    The pairs of a round have no column in common and are rotated at once.
    """
    columns = np.array(factor, float)
    rounds = _rounds(columns.shape[1])
    for _ in range(sweeps):
        widest = 0.0
        for i, j in rounds:
            a, b = columns[:, i], columns[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > ANGLE_TOLERANCE * scale
            widest = max(widest, float((np.abs(gamma[turn]) / scale[turn]).max(initial=0.0)))
            g = np.where(turn, gamma, 1.0)
            zeta = (beta - alpha) / (2 * g)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            columns[:, i], columns[:, j] = c * a - t * c * b, t * c * a + c * b
        if widest <= 4 * ANGLE_TOLERANCE:
            break
    values = (columns * columns).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, columns = values[order], columns[:, order]
    keep = values > RANK_TOLERANCE * values.max(initial=0.0)
    return values[keep], columns[:, keep] / np.sqrt(values[keep])


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows of finite vectors with x, floor(scale * c) + 0 of each entry, in a column ``x``.

    A row is left out if its vector is null or empty, or holds a null or non-finite entry.
    An entry beyond a long takes the nearest long.
    """
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = rows.where(F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
    x = F.transform(c, lambda e: F.floor(e * float(scale)).cast("bigint"))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


@dataclass(frozen=True)
class Fit:
    """What the distinct vectors say: their number, sums by dimension, components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where all fit, else as Python numbers."""
    most = max([abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *(abs(s) // n for s in sums)])
    if most * n * 4 < _LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(float)


def _sums(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(vectors, sum of each dimension), exact: the low and high halves of entries are summed apart."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                n += len(x)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
        columns = [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(columns, names=["d", "n", "low", "high"])

    parts = distinct.select("x").mapInArrow(halves, "d int, n bigint, low bigint, high bigint")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # One row for each dimension.
    summed = parts.groupBy("d").agg(exact("n").alias("n"), exact("low").alias("low"), exact("high").alias("high"))
    found = sorted(summed.collect())
    return int(found[0]["n"]) if found else 0, [int(r["low"]) + (int(r["high"]) << 32) for r in found]


def _products(vectors: DataFrame, dims: int, centred) -> np.ndarray:
    """The sum over all rows of the products of entries of ``centred`` vectors, a matrix.

    Each task sums its own; the parts are shuffled by row of the matrix.
    """
    names = ["d", "products"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            rows = [np.ascontiguousarray(r).tobytes() for r in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[d] = sums.get(d, 0.0) + np.frombuffer(row.as_py(), float)
        columns = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = vectors.select("x").mapInArrow(products, "d int, products binary")
    whole = np.zeros((dims, dims))
    # A row for each row of the matrix; its size does not depend on the number of vectors.
    for row in parts.repartition("d").mapInArrow(summed, "d int, products binary").collect():
        whole[row["d"]] = np.frombuffer(row["products"], float)
    return whole


def fitted(distinct: DataFrame, dims: int) -> Fit | None:
    """The components of distinct vectors ``x`` of one width; None for no vectors."""
    n, sums = _sums(distinct, dims)
    if not n:
        return None
    covariance = _products(distinct, dims, lambda x: _centred(x, n, sums)) / n
    values, components = one_sided_jacobi(pivoted_cholesky((covariance + covariance.T) / 2))
    return Fit(n, sums, values, components, float(np.trace(covariance)))


def whitened(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    A row for each finite vector and each of the first components, those that repeat an
    id or a vector included; the fit takes each distinct vector once. Vectors
    of another width than most have (of equally many the widest) take no part. A null vec_id stays null.
    Where the vectors span fewer dimensions there are fewer components, and with fewer
    than two distinct vectors none: no rows. Components of equal eigenvalues may come in any order.
    A deviation beyond a long is null. ``whitened``: the centred vector on the component, over
    the root of the eigenvalue. ``explained``: the eigenvalue's part of all variance.
    ``identity_error``: how far the covariance of the whitened fit list is from the identity.
    """
    spark = rows.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = stored(whole_vectors(rows, scale), "whole")
    width = free_name(vectors, "_width")
    common = vectors.groupBy(F.size("x").alias(width)).count().orderBy(F.desc("count"), F.desc(width)).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common[width]
    vectors = vectors.where(F.size("x") == dims)
    distinct = stored(vectors.select("x").distinct(), "distinct")
    fit = fitted(distinct, dims)
    k = min(components, len(fit.values))
    if not k:
        return spark.createDataFrame([], schema)
    n, sums, trace = fit.n, fit.sums, fit.trace
    project = fit.components[:, :k] / np.sqrt(fit.values[:k])
    spread = _products(distinct, k, lambda x: _centred(x, n, sums) @ project) / n
    error = float(np.abs(spread - np.eye(k)).max())
    explained = (fit.values[:k] / trace).tolist()

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            y = _deviations(x, n, sums)
            w = (y / n).astype(float) @ project
            exact = (y.astype(object) ** 2).sum(axis=1) if _far(y) else (y * y).sum(axis=1)
            deviation = [int(d) if d <= _LONG else None for d in exact.tolist()]
            columns = [
                batch.column(1).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                pa.array(w.ravel()),
                pa.array(explained * len(x), pa.float64()),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return vectors.select("x", "vec_id").mapInArrow(projected, schema)


def _far(y: np.ndarray) -> bool:
    """Whether the squares of a row may exceed a long."""
    most = max(abs(int(y.min())), abs(int(y.max())))
    return y.dtype == object or most * most * y.shape[1] > _LONG
