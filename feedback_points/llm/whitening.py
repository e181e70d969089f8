"""Whitening of vectors by a covariance from variances alone (polarisation).

The covariance of two dimensions is half of what the variance of their sum exceeds the sum of their
variances by. So one pass adds up exact squares of centred values for every dimension and for every sum of
two dimensions; nothing is multiplied across dimensions, and all numbers are whole until the covariance
matrix is assembled for the eigenvectors.

Entries become whole numbers ``x = floor(scale * c) + offset``. With n vectors and sums S, the centred value
is n*x - S. Tasks add up squares of y = x - floor(S/n), which is within one of the mean, and n*x - S = n*y - r
with r = S mod n, so its squares follow exactly from the sums of y and of its squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Whole entries are held within this size, beyond all vectors of use.
LARGEST = 1 << 60
#: Eigenvalues below this share of the largest are noise of the computation.
FLAT = 1e-12

_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows whose vector is not null and has finite entries only."""
    values = F.col(vector).cast("array<double>")
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), values.alias("embedding"))


def _matrix(column: pa.ListArray, width: int, scale: int, offset: int) -> np.ndarray:
    c = column.flatten().to_numpy().reshape(-1, width)
    return np.clip(np.floor(scale * c), -LARGEST, LARGEST).astype(np.int64) + offset


def _sums(rows: DataFrame, width: int, scale: int, offset: int) -> list[int]:
    """Exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width, scale, offset)
            exact = x if len(x) and int(np.abs(x).max()) * len(x) <= _LONG else x.astype(object)
            total = [t + int(s) for t, s in zip(total, exact.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["dim", "total"])

    parts = rows.select("embedding").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    return [int(r["total"]) for r in parts.orderBy("dim").collect()]  # a row per dimension


def _square_sums(y: np.ndarray) -> np.ndarray:
    """Of whole rows, the sums of squares of each dimension (diagonal) and of each sum of two dimensions."""
    width = y.shape[1]
    largest = 2 * int(np.abs(y).max(initial=0))
    fits = largest * largest * len(y) <= _LONG
    y = np.ascontiguousarray(y.T) if fits else y.T.astype(object)
    out = np.zeros((width, width), y.dtype)
    for i in range(width):
        out[i, i] = (y[i] * y[i]).sum()
        both = y[i + 1 :] + y[i]
        out[i, i + 1 :] = np.einsum("dn,dn->d", both, both) if fits else (both * both).sum(1)
    return out


def _variances(rows: DataFrame, pivot: list[int], scale: int, offset: int) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Sums of y by dimension, and of the squares by dimension and by pair of dimensions."""
    width = len(pivot)
    upper = np.triu_indices(width)
    middle = np.array(pivot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(width, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            for k in range(0, len(batch), 4096):
                y = _matrix(batch.column(0).slice(k, 4096), width, scale, offset) - middle
                first += y.astype(object).sum(0) if int(np.abs(y).max(initial=0)) > 1 << 50 else y.sum(0).astype(object)
                second += _square_sums(y)[upper].astype(object)
        made = [(i, -1, int(t)) for i, t in enumerate(first)] + [(int(i), int(j), int(t)) for i, j, t in zip(*upper, second, strict=True)]
        i, j, t = zip(*made, strict=True)
        # two parts of each number, so that sums of any size stay exact
        high = [x >> 60 for x in t]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, high), pa.decimal128(38, 0)), pa.array([x & (1 << 60) - 1 for x in t], pa.int64())], ["i", "j", "high", "low"])

    parts = rows.select("embedding").mapInArrow(run, "i int, j int, high decimal(38,0), low long")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()  # a row per pair of dimensions
    number = {(r["i"], r["j"]): (int(r["high"]) << 60) + int(r["low"]) for r in found}
    return {i: t for (i, j), t in number.items() if j < 0}, {k: t for k, t in number.items() if k[1] >= 0}


def covariance(n: int, sums: list[int], first: dict[int, int], second: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix (divisor n), each entry rounded once from an exact number."""
    width = len(sums)
    rest = [s - n * (s // n) for s in sums]

    def centred(y1: int, y2: int, r: int) -> int:
        """Sum of (n*y - r)**2 over all n vectors."""
        return n * n * y2 - 2 * n * r * y1 + n * r * r

    own = [centred(first[i], second[i, i], rest[i]) for i in range(width)]
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, width):
            both = centred(first[i] + first[j], second[i, j], rest[i] + rest[j])
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**3)
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable vector and component.

    Rows with a null vector, or null or non-finite entries, are dropped, and so are vectors that are not as
    long as most are (the longest in a tie). Repeated rows and null ids stay, other columns are ignored.
    Components without variance are left out, so equal vectors, or none, give no rows. ``deviation`` is
    null where it is no 64-bit number. Entries beyond 2**60 count as that.
    """
    rows = usable(bounded_batches(vectors), id_col, vector)
    sizes = rows.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).where("width > 0").orderBy(F.desc("n"), F.desc("width")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, n = sizes["width"], sizes["n"]
    rows = rows.where(F.size("embedding") == width)
    sums = _sums(rows, width, scale, offset)
    pivot = [s // n for s in sums]
    v = covariance(n, sums, *_variances(rows, pivot, scale, offset))
    values, directions = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    order = order[values[order] > FLAT * max(values.max(), 0.0)]
    if not len(order) or values.max() <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    explained = (values[order] / np.trace(v)).tolist()
    turn = directions[:, order] / np.sqrt(values[order])
    rest = np.array([s - n * p for s, p in zip(sums, pivot, strict=True)])
    middle, share = np.array(pivot, np.int64), rest / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), width, scale, offset) - middle
            fits = (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * width <= _LONG
            if fits:
                deviation = pa.array(((n * y - rest) ** 2).sum(1), pa.int64())
            else:
                exact = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(1)
                deviation = pa.array([int(d) if d <= _LONG else None for d in exact], pa.int64())
            made = (y - share) @ turn
            offsets = pa.array(np.arange(len(y) + 1) * made.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(made).reshape(-1)))], ["vec_id", "deviation", "w"])

    made = stage(rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whitened")
    k = len(order)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = lambda i: F.get("w", F.lit(i))
    measured = made.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(measured[f"c{i}_{j}"] - float(i == j)) for i, j in pairs)
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(x) for x in explained]), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
