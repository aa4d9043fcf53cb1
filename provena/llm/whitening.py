"""Embedding whitening by cyclic Jacobi.

The exact integer sums, the centred scatter and the scatter of the whitened values are each one pass
over the vectors: a task folds its vectors into one matrix, the rows of the matrices are added by
shuffle, and only dims * dims numbers reach the driver, however many vectors there are. There
symmetric Jacobi rotations go through all pairs of dimensions until the off-diagonals vanish, which
keeps small eigenvalues accurate; the sorted whitening matrix is broadcast.

Defined results: rows without a vector, or with null or non-finite entries in it, are dropped, and so
are vectors with an entry of 2 ** 52 or more, and vectors that have not the commonest length (the longer of
equally common ones), empty ones included; a direction in which the vectors don't vary (eigenvalue within rounding of zero) can't be
whitened and has no component; repeated rows count as often as they stand there and a null id is an
id; a deviation beyond a long is null; a table without vectors gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become whole numbers floor(SCALE * entry) + SHIFT; how many components a row gets; sweeps of rotations at most.
SCALE, SHIFT, COMPONENTS, SWEEPS = 1024, 100_000, 8, 60
#: Vectors that a task works on at once; entries from this size on, infinite ones among them, have no whole number.
AT_ONCE, LARGEST = 4096, 2.0**52


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors that remain, as whole numbers."""
    entry = lambda c: F.when(F.abs(c.cast("double")) < LARGEST, F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    numbers = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), entry).alias("x"))
    return numbers.where(F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def _added(x: DataFrame, dims: int, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of fold(block of vectors), a matrix of floats that each task adds up for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for piece in _pieces(batches):
            part = fold(_matrix(piece.column("x"), dims))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "cells"])

    cells = x.select("x").mapInArrow(run, "row int, cells array<double>").select("row", F.posexplode("cells").alias("col", "v"))
    found = cells.groupBy("row", "col").agg(F.sum("v").alias("v")).toArrow()
    row, col = found["row"].to_numpy(), found["col"].to_numpy()
    out = np.zeros((1 + row.max(), 1 + col.max()))
    out[row, col] = found["v"].to_numpy()
    return out


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors as columns, by cyclic sweeps of rotations."""
    a = np.array(symmetric, np.float64)
    d = len(a)
    v = np.eye(d)
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= np.finfo(float).eps * np.sqrt(abs(a[p, p] * a[q, q])) or abs(off) < np.finfo(float).tiny:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                for m in (a.T, a, v.T):  # columns, rows, and the columns of the vectors
                    m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The exact n * x - S: longs where they fit, else Python's whole numbers."""
    if sums.dtype == np.int64 and (not x.size or int(np.abs(x).max()) * n < 1 << 62):
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _offsets(x, n, sums).astype(np.float64) / n


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The exact sum of (n * x - S) ** 2 of each vector, null beyond a long."""
    off = _offsets(x, n, sums)
    if off.dtype == np.int64 and int(np.abs(off).max()) ** 2 * off.shape[1] < 1 << 63:
        return pa.array((off * off).sum(axis=1))
    exact = [sum(int(k) ** 2 for k in row) for row in off]
    return pa.array([k if k < 1 << 63 else None for k in exact], pa.int64())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sound = whole(vectors, id_col, vector_col)
    lengths = sound.where(F.size("x") > 0).groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if commonest is None:
        return sound.sparkSession.createDataFrame([], schema)
    dims, n = commonest["dims"], commonest["n"]
    rows = sound.where(F.size("x") == dims)
    totals = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    sums = np.array([int(t["s"]) for t in totals], object)
    sums = sums.astype(np.int64) if max(map(abs, sums)) < 1 << 62 else sums

    def scatter(block: np.ndarray) -> np.ndarray:
        off = _centred(block, n, sums)
        return off.T @ off

    variance = _added(rows, dims, scatter) / n
    values, axes = jacobi((variance + variance.T) / 2)
    used = int(np.sum(values > max(values[0], 0.0) * dims * np.finfo(float).eps)) if values[0] > 0 else 0
    used = min(components, used)
    if not used:
        return sound.sparkSession.createDataFrame([], schema)
    matrix, explained = axes[:, :used] / np.sqrt(values[:used]), values[:used] / np.trace(variance)
    project = lambda block: _centred(block, n, sums) @ matrix
    middle = _added(rows, dims, lambda block: project(block).sum(axis=0, keepdims=True))[0] / n

    def again(block: np.ndarray) -> np.ndarray:
        off = project(block) - middle
        return off.T @ off

    error = float(np.abs(_added(rows, dims, again) / n - np.eye(used)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            block = _matrix(piece.column("x"), dims)
            m = len(block)
            again = np.repeat(np.arange(m), used)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * used, n, np.int64)),
                    _deviation(block, n, sums).take(pa.array(again)),
                    pa.array(project(block).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * used, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(out, schema)

