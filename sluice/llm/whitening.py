"""Whitening of embeddings by shifted CholeskyQR.

The centred rows are orthogonalised again and again: a distributed pass sums their Gram matrix, the driver takes
its Cholesky factor, and the next pass solves the rows by all factors so far. The first factors are shifted, so
that they exist for rows of any condition. The composed factor R has the rows' singular values and right
vectors; its SVD gives the components, and the solved rows times its left vectors are the whitened rows.
Only matrices of the dimension's size reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
# entries of a rows' matrix that are handled at once
CELLS = 1 << 18
# the pass after which rows count as orthogonal: largest entry of their covariance minus the identity
ORTHOGONAL, PASSES = 1e-12, 12
UNIT = 2.0**-53
LONG = 2.0**62


class Fit(NamedTuple):
    """What every task needs: rows, sums, dimensions that vary, factors, left vectors, eigenvalue shares, the error."""

    n: int
    sums: list[int]
    live: np.ndarray
    factors: list[np.ndarray]
    left: np.ndarray
    explained: np.ndarray
    error: float


def entries(vectors: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a vector of that many finite entries (of the first length seen, if none is given) and these as whole numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat, owner = vectors.flatten(), np.repeat(np.arange(len(vectors)), np.maximum(lengths, 0))
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        cells = np.floor(SCALE * values)
        bad = np.bincount(owner[~(np.abs(cells) < LONG)], minlength=len(vectors)) > 0
    fine = (lengths >= 0) & ~bad & (True if dimension is None else lengths == dimension)
    return np.flatnonzero(fine), cells[fine[owner]].astype(np.int64) + OFFSET


def _sums(values: np.ndarray) -> list[int]:
    """Exact column sums."""
    if not values.size:
        return [0] * values.shape[1]
    small = float(np.abs(values).max()) * len(values) < LONG
    return [int(s) for s in (values if small else values.astype(object)).sum(0)]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors, how many rows there are and the sum, least and largest value of each place."""
    totals: dict[int, list] = {}
    for batch in batches:
        vectors = batch.column(0)
        lengths = pc.list_value_length(vectors)
        for size in {v for v in pc.unique(lengths).to_pylist() if v}:
            rows, flat = entries(vectors.filter(pc.equal(lengths, size)), size)
            if not len(rows):
                continue
            values = flat.reshape(-1, size)
            own = totals.setdefault(size, [0, [0] * size, values.min(0), values.max(0)])
            own[0] += len(values)
            own[1] = [a + b for a, b in zip(own[1], _sums(values))]
            own[2], own[3] = np.minimum(own[2], values.min(0)), np.maximum(own[3], values.max(0))
    out = [(size, i, n, sums[i], int(low[i]), int(high[i])) for size, (n, sums, low, high) in totals.items() for i in range(size)]
    cols = list(zip(*out)) or [()] * 6
    types = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
    names = ["length", "place", "n", "total", "low", "high"]
    yield pa.RecordBatch.from_arrays([pa.array([*map(Decimal, c)] if t == types[3] else list(c), t) for c, t in zip(cols, types)], names)


def _centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact n*x - S where that fits a long."""
    top = max(float(np.abs(values).max(initial=0)), max(abs(s) / n for s in sums))
    if top * n < LONG:
        return (values * n - np.array(sums, np.int64)) / n
    exact = values.astype(object) * n - np.array(sums, object)
    return (exact / n).astype(np.float64)


def _deviation(values: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n*x - S)^2, None where it does not fit a long."""
    top = max(float(np.abs(values).max(initial=0)), max(abs(s) / n for s in sums))
    if top * n < LONG:
        scaled = values * n - np.array(sums, np.int64)
        if (float(np.abs(scaled).max(initial=0)) ** 2) * values.shape[1] < LONG:
            return (scaled * scaled).sum(1).tolist()
    exact = values.astype(object) * n - np.array(sums, object)
    return [s if s < 2**63 else None for s in (exact * exact).sum(1)]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ..., one triangular solve after the other."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _blocks(column: pa.Array, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number rows, so many at once that a block stays small."""
    step = max(1, CELLS // dimension)
    for at in range(0, len(column), step):
        rows, flat = entries(column.slice(at, step), dimension)
        if len(rows):
            yield rows + at, flat.reshape(-1, dimension)


def _gram(fit: Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the Gram matrix of the solved rows, with a column of ones for their sums."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(fit.live) + 1
        total = np.zeros((size, size))
        for batch in batches:
            for _, values in _blocks(batch.column(0), len(fit.sums)):
                q = solved(_centred(values, fit.n, fit.sums)[:, fit.live], fit.factors)
                q = np.column_stack([q, np.ones(len(q))])
                total += q.T @ q
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "value"])

    return gram


def gram(vectors: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of the solved rows over all tasks."""
    parts = vectors.mapInArrow(_gram(fit), "i long, j long, value double")
    size = len(fit.live) + 1
    full = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # one row for each entry of the matrix
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["value"]
    return full[:-1, :-1], full[:-1, -1]


def factor(matrix: np.ndarray) -> np.ndarray:
    """Upper Cholesky factor, shifted where the matrix is too near to a singular one."""
    size = len(matrix)
    low, high = np.linalg.eigvalsh(matrix)[[0, -1]]
    shift = 11 * size * (size + 1) * UNIT * high
    if low > 100 * shift:
        return np.linalg.cholesky(matrix).T
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fit over all rows of a one-column table of vectors; None if nothing varies."""
    places = vectors.mapInArrow(_summed, "length long, place long, n long, total decimal(38,0), low long, high long").groupBy(
        "length", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = places.groupBy("length").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return None
    own = sorted(places.where(F.col("length") == best["length"]).collect(), key=lambda r: r["place"])  # one row for each dimension
    live = np.array([r["place"] for r in own if r["low"] < r["high"]], np.int64)
    if not len(live):
        return None
    n = int(best["n"])
    fit = Fit(n, [int(r["total"]) for r in own], live, [], np.eye(len(live)), np.ones(len(live)), 0.0)
    composed = np.eye(len(live))
    trace = 0.0
    for turn in range(PASSES):
        matrix, sums = gram(vectors, fit)
        if turn == 0:
            trace = float(np.trace(matrix)) / n
        left, values, right = np.linalg.svd(composed)
        # directions below rounding have no variance; the first turn knows no singular values yet
        kept = values > 16 * len(live) * 2 * UNIT * values[0]
        left, values, right = left[:, kept], values[kept], right[kept]
        signs = np.where(right[np.arange(len(right)), np.abs(right).argmax(1)] < 0, -1.0, 1.0)
        left = (left * signs)[:, :components]
        mean = sums / n
        error = left.T @ (matrix - n * np.outer(mean, mean)) @ left - np.eye(left.shape[1])
        fit = fit._replace(left=left, explained=(values**2 / n / trace)[:components], error=float(np.abs(error).max()))
        if turn and fit.error <= ORTHOGONAL * len(live):
            break
        if turn < PASSES - 1:
            r = factor(matrix)
            composed = r @ composed
            fit = fit._replace(factors=[*fit.factors, r])
    return fit


def _whitened(fit: Fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = fit.left.shape[1]
        for batch in batches:
            for rows, values in _blocks(batch.column(1), len(fit.sums)):
                q = solved(_centred(values, fit.n, fit.sums)[:, fit.live], fit.factors) @ fit.left * np.sqrt(fit.n)
                each = np.repeat(np.arange(len(rows)), width)
                deviation = pa.array(_deviation(values, fit.n, fit.sums), pa.int64())
                count = len(each)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(count, fit.n)), deviation.take(pa.array(each)), pa.array(q.ravel()),
                    pa.array(np.tile(fit.explained, len(rows))), pa.array(np.full(count, fit.error)),
                ], ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whitened


def whitened(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per row and component its whitened value, with the fit's figures.

    Left out are rows whose vector is null, is empty, holds null or non-finite entries or entries of which 64 times
    does not fit a long, or has not the most frequent length (of two, the longer). Components are numbered from 1
    by falling eigenvalue; directions without variance, be it constant places or linear dependence, have none, so
    a table whose vectors are all equal gives no rows, as does an empty one. Repeated rows and null ids count and come
    out like any others. ``deviation`` is null where it does not fit a long. Each component's sign makes its largest
    entry positive. Other columns are not read.
    """
    id_type = rows.schema[id_column].dataType
    schema = T.StructType([T.StructField("_id", id_type)] + T._parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    own = rows.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"))
    fit = fitted(own.select("_vector"), components)
    if fit is None:
        return own.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_column)
    return own.mapInArrow(_whitened(fit), schema).withColumnRenamed("_id", id_column)
