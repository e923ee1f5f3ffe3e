"""Whitening by LOBPCG: leading eigenvectors of a covariance that is never formed.

Spark multiplies the covariance with a block of columns: each task centres its rows, multiplies them with the block and
back, and the tasks' products are summed. The block is an orthonormal basis of the iterate, its residuals and the last
direction; Rayleigh-Ritz on it gives the next iterate. It ends when the residuals, taken from products with the rows
themselves, are as small as doubles allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import few_tasks, table
from pagewatch.llm.vectors import STRIPS, SUMS, exact, finite, floors, matrices, part_sums, strips, summed, sums_batch, total_sums

#: Scale of the integers, components, and columns of the iterate beyond these, which speed up convergence.
SCALE, COMPONENTS, GUARD = 256, 4, 16
#: Residuals in units of the largest eigenvalue: good enough to end at once; to end when they stop falling; rounds at most.
BEST, CERTIFIED, ROUNDS = 1e-14, 1e-10, 300
#: Eigenvalues under this share of the largest count as zero.
ZERO = 1e-12


@dataclass
class Moments:
    """Of the fit list: vectors, exact sums by dimension, their means."""

    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded quotients of integers


@dataclass
class Model:
    moments: Moments
    vectors: np.ndarray  # (width, components), of unit length
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float  # the largest, in units of the largest eigenvalue


def moments(fit: DataFrame, width: int) -> Moments:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((1, width + 1), np.int64), np.zeros((1, width + 1), np.int64)
        for _, x in matrices(batches, width):
            for whole, some in zip((high, low), part_sums(np.c_[x, np.ones(len(x), np.int64)], np.zeros(len(x), np.int64), 1), strict=True):
                whole += some
        yield sums_batch(high, low)

    *sums, n = total_sums(fit.select("x").mapInArrow(run, SUMS), 1, width)[0]
    return Moments(n, sums)


def product(fit: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The covariance times block's columns. Each task gives one matrix of block's shape; Spark sums them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for _, x in matrices(batches, len(mean)):
            centred = x - mean
            total += centred.T @ (centred @ block)
        yield strips(total)

    return summed(few_tasks(fit.select("x")).mapInArrow(run, STRIPS), block.shape) / n


def trace(fit: DataFrame, mean: np.ndarray, n: int) -> float:
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([float(sum(((x - mean) ** 2).sum() for _, x in matrices(batches, width)))])], ["s"])

    return fit.select("x").mapInArrow(run, "s double").agg(F.sum("s").alias("s")).first().s / n


def basis(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns; those that earlier ones hold already are left out."""
    out = np.zeros((blocks[0].shape[0], 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            for _ in range(2):
                column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if size and left > 1e-10 * size:
                column = column / left
                column = column - out @ (out.T @ column)
                out = np.c_[out, column / np.linalg.norm(column)]
    return out


def lobpcg(multiply, width: int, k: int, guard: int = GUARD, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, falling, their vectors as columns, and the largest residual over the largest eigenvalue.

    multiply: gives the matrix times a block. Raises if the residuals don't reach CERTIFIED.
    """
    k = min(k, width)
    size = min(width, k + guard)
    start = np.random.default_rng(seed).normal(size=(width, size))
    tried, best = basis(start), None
    for _ in range(ROUNDS):
        image = multiply(tried)
        gram = tried.T @ image
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        values, turn = values[::-1][:size], turn[:, ::-1][:, :size]
        iterate = tried @ turn
        left = image @ turn - iterate * values
        largest = max(float(values[0]), 0.0)
        worst = float(np.linalg.norm(left[:, :k], axis=0).max()) / largest if largest else 0.0
        stuck = best is not None and worst <= CERTIFIED and worst > best[2] / 2
        if best is None or worst < best[2]:
            best = (values[:k].copy(), iterate[:, :k].copy(), worst)
        if worst <= BEST or stuck or tried.shape[1] == width and worst <= CERTIFIED:
            return best
        direction = tried[:, size:] @ turn[size:]  # what the step added to the last iterate
        tried = basis(iterate, left, direction)
    raise RuntimeError(f"residuals of {best[2]:.1e} of the largest eigenvalue after {ROUNDS} rounds")


def fit_model(fit: DataFrame, width: int, k: int = COMPONENTS) -> Model | None:
    """The model of a table of distinct vectors x; None if it has no variance. Components with no variance are left out."""
    found = moments(fit, width)
    if not found.n:
        return None
    mean = found.mean
    whole = trace(fit, mean, found.n)
    if not whole:
        return None
    values, vectors, worst = lobpcg(lambda block: product(fit, mean, found.n, block), width, k)
    there = values > ZERO * values[0]
    values, vectors = values[there], vectors[:, there] / np.linalg.norm(vectors[:, there], axis=0)
    spread = vectors.T @ product(fit, mean, found.n, vectors) / np.sqrt(np.outer(values, values))
    return Model(found, vectors, values, whole, float(np.abs(spread - np.eye(len(values))).max()), worst)


def deviations(x: np.ndarray, found: Moments) -> list[int]:
    """Sums over dimensions of (n x - S)^2, exact."""
    n, sums = found.n, found.sums
    rows = exact(x)
    squares = (rows * rows).sum(axis=1)
    wide = max(map(abs, sums)) * (int(np.abs(x).max()) + 1) * x.shape[1] >= 1 << 62 if len(x) else False
    dots = x.astype(object) @ np.array(sums, object) if wide else x @ np.array(sums, np.int64)
    constant = sum(s * s for s in sums)
    return [n * n * int(q) - 2 * n * int(p) + constant for q, p in zip(squares, dots, strict=True)]


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per kept row of embeddings and component.

    embeddings: vec_id, embedding. Rows whose vector is null, empty or holds null, NaN or infinite entries are left out, as are
    vectors of another length than most have (of equally common ones the longest). Entries become floor(256 c); beyond the range of a
    long, its nearest end. Fitted is each distinct vector once; rows come back each, repeated and null vec_ids too. There are as many
    components as eigenvalues over 0, k at most; none, and so no row, if all vectors are equal. deviation is a decimal of 38
    digits, null beyond. The signs and, of equal eigenvalues, the directions are those of one run. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    kept = embeddings.where(finite(F.col("embedding")) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), floors(F.col("embedding"), SCALE).alias("x"))
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    size = kept.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if size is None:
        return spark.createDataFrame([], kinds)
    width = size.width
    kept = kept.where(F.size("x") == width)
    model = fit_model(table(kept.select("x").distinct(), "distinct-vectors"), width, k)
    if model is None:
        return spark.createDataFrame([], kinds)
    sent = spark.sparkContext.broadcast(model)  # width x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        mean, scaled, top = m.moments.mean, m.vectors / np.sqrt(m.values), len(m.values)
        for part, x in matrices(batches, width):
            rows = len(x)
            at = pa.array(np.repeat(np.arange(rows), top))
            deviation = pa.array([d if d < 10**38 else None for d in deviations(x, m.moments)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, top + 1), rows), pa.int32()), pa.array(np.full(rows * top, m.moments.n)), deviation.take(at),
                pa.array(((x - mean) @ scaled).reshape(-1)), pa.array(np.tile(m.values / m.trace, rows)), pa.array(np.full(rows * top, m.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, kinds)
