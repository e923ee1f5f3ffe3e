"""Rows of numbers in Arrow batches, as matrices of exact integers, and exact sums over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix at once.
ROWS_AT_ONCE = 8192
#: Below this, products of two entries and their sums over up to 64 dimensions fit a long.
SMALL = 1 << 27


def finite(vector: Column) -> Column:
    """Whether the vector and all its entries are there, and finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry c, as double, as long; beyond the range of a long its nearest end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def matrices(batches: Iterator[pa.RecordBatch], width: int, name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, with their vectors as rows of a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, part.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """x, of Python integers if it or another has entries so large that longs might not do."""
    large = any(a.size and (a.dtype == object or max(-int(a.min()), int(a.max())) >= SMALL) for a in (x, *others))
    return x.astype(object) if large else x


def longs(found: np.ndarray) -> pa.Array:
    """As longs; null where one doesn't fit."""
    if found.dtype != object:
        return pa.array(found, pa.int64())
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in found], pa.int64())


#: A part's sums as two longs each: value = high * 2**32 + low.
SUMS = "cluster int, dim int, high long, low long"


def part_sums(x: np.ndarray, cluster: np.ndarray, k: int, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(k, width) sums of the high and low halves of the rows of each cluster; exact for 2**31 rows."""
    high, low = np.zeros((k, x.shape[1]), np.int64), np.zeros((k, x.shape[1]), np.int64)
    for c in np.unique(cluster):
        own = x[cluster == c]
        high[c], low[c] = sign * (own >> 32).sum(0), sign * (own & 0xFFFFFFFF).sum(0)
    return high, low


def sums_batch(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMS; the last column of each row of the matrices is its number of vectors, in `low`."""
    cluster, dim = np.nonzero(high | low)
    return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(high[cluster, dim]), pa.array(low[cluster, dim])], ["cluster", "dim", "high", "low"])


def total_sums(rows: DataFrame, k: int, width: int) -> list[list[int]]:
    """Rows of SUMS, summed to k lists of width + 1 integers. The result has k * (width + 1) rows at most."""
    wide = [F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in ("high", "low")]
    out = [[0] * (width + 1) for _ in range(k)]
    for r in rows.groupBy("cluster", "dim").agg(*wide).collect():
        out[r.cluster][r.dim] = int(r.high) * (1 << 32) + int(r.low)
    return out


#: Numbers of a matrix that go in one row when tasks' matrices are summed.
STRIP = 16
STRIPS = "place long, " + ", ".join(f"v{i} double" for i in range(STRIP))


def strips(found: np.ndarray) -> pa.RecordBatch:
    """The matrix in rows of STRIPS; rows of zeros are left out."""
    flat = np.zeros(-(-found.size // STRIP) * STRIP)
    flat[: found.size] = found.reshape(-1)
    rows = flat.reshape(-1, STRIP)
    place = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(rows[place, i]) for i in range(STRIP))], ["place", *(f"v{i}" for i in range(STRIP))])


def summed(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the matrices whose strips are rows; Spark adds them up, and the driver gets one matrix of that shape."""
    got = rows.groupBy("place").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(STRIP))).toArrow()
    size = int(np.prod(shape))
    out = np.zeros((-(-size // STRIP), STRIP))
    out[got.column("place").to_numpy()] = np.column_stack([got.column(f"v{i}").to_numpy() for i in range(STRIP)]) if got.num_rows else 0
    return out.reshape(-1)[:size].reshape(shape)
