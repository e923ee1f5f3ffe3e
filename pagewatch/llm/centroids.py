"""Centroid clustering by delta Lloyd: what a round must look at is kept from the one before.

Vectors are integers, so sums and centroids are exact whatever the order of rows. A vector's centroid and distance are
kept in a written table, the clusters' sums and sizes on the driver. A round compares a vector with the centroids that
moved; only if its own moved, with all. Vectors that change their cluster give signed transfers, summed by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import scratch, written
from pagewatch.llm.vectors import SUMS, exact, finite, floors, longs, matrices, part_sums, sums_batch, total_sums

#: Scale of the integers, clusters, rounds, dimensions, and what the hash that picks the first centroids begins with.
SCALE, CLUSTERS, ROUNDS, WIDTH, SEED = 1024, 8, 10, 64, 3

STATE = "vec_id long, x array<bigint>, cluster int, distance long, was int"


def distances(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Squared Euclidean distances, exact."""
    at = exact(np.array(centroid, object if any(abs(c) >= 1 << 62 for c in centroid) else np.int64), x)
    gap = exact(x, at) - at
    return (gap * gap).sum(axis=1) if gap.dtype == object else np.einsum("ij,ij->i", gap, gap)


def _nearer(best: np.ndarray, owner: np.ndarray, found: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Takes a centroid where it is nearer, or as near and of a smaller number. An owner of -1 is none."""
    if found.dtype == object:
        best = best.astype(object)
    better = ((owner < 0) | (found < best) | ((found == best) & (number < owner))).astype(bool)
    return np.where(better, found, best), np.where(better, number, owner)


def nearest(x: np.ndarray, centroids: list[list[int]], owner: np.ndarray, known: np.ndarray, moved: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and its distance.

    owner, known: those of the round before (owner -1: none). Vectors whose owner didn't move are compared with the moved centroids only.
    """
    lost = (owner < 0) | np.isin(owner, moved)
    owner, best = np.where(lost, -1, owner), known
    for number, centroid in enumerate(centroids):
        some = slice(None) if number in moved else lost
        if number in moved or lost.any():
            found_best, found_owner = _nearer(best[some], owner[some], distances(x[some], centroid), number)
            if found_best.dtype == object:
                best = best.astype(object)
            best[some], owner[some] = found_best, found_owner
    return owner, best


def _assigned(state: DataFrame, centroids: list[list[int]], moved: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, WIDTH):
            was = part.column("cluster").to_numpy(zero_copy_only=False)
            known = part.column("distance")
            lost = known.is_null().to_numpy(zero_copy_only=False)  # a distance beyond a long is found again
            before = np.where(lost, -1, was).astype(np.int64)
            owner, best = nearest(x, centroids, before, known.fill_null(0).to_numpy(zero_copy_only=False).copy(), moved)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(owner, pa.int32()), longs(best), pa.array(was, pa.int32())], ["vec_id", "x", "cluster", "distance", "was"])

    return state.select("vec_id", "x", "cluster", "distance").mapInArrow(run, STATE)


def transfers(state: DataFrame, k: int) -> list[list[int]]:
    """What the vectors that changed their cluster add to, and take from, its sums and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((k, WIDTH + 1), np.int64), np.zeros((k, WIDTH + 1), np.int64)
        for part, x in matrices(batches, WIDTH):
            new, old = (part.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "was"))
            own = np.c_[x, np.ones(len(x), np.int64)]
            for at, sign in ((new, 1), (old, -1)):
                there = at >= 0
                for whole, some in zip((high, low), part_sums(own[there], at[there], k, sign), strict=True):
                    whole += some
        yield sums_batch(high, low)

    changed = state.where("cluster <> was").select("x", "cluster", "was")
    return total_sums(changed.mapInArrow(run, SUMS), k, WIDTH)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least sha256 of `seed:vec_id`; null vec_ids last, ties by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.x for r in vectors.select("x", key.alias("key")).orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per vector.

    embeddings: vec_id, embedding. Kept are vectors of WIDTH components, none null, NaN or infinite; others have no row. A
    component x becomes floor(1024 x); beyond the range of a long, its nearest end. Repeated vec_ids and vectors count each; a
    null vec_id is kept, but starts no centroid while others do. Ties go to the smaller number. Fewer vectors than k give as many
    centroids. A distance or inertia beyond a long is null. An empty table gives an empty result; other columns are ignored.
    Rounds end early once no centroid moves, as nothing would change.
    """
    spark = embeddings.sparkSession
    kept = embeddings.where((F.size("embedding") == WIDTH) & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), floors(F.col("embedding"), SCALE).alias("x"))
    centroids = first_centroids(kept, k, seed)
    totals = [[0] * (WIDTH + 1) for _ in centroids]
    state = kept.selectExpr("vec_id", "x", "-1 cluster", "cast(null as long) distance")
    moved, before = list(range(len(centroids))), None
    for round_ in range(rounds + 1):
        with scratch(spark) as gone:
            state, path = written(_assigned(state, centroids, moved), "clusters", keep=True)
            gone += [before] if before else []
        before = path
        if round_ == rounds:
            break
        for sums, more in zip(totals, transfers(state, len(centroids)), strict=True):
            sums[:] = [a + b for a, b in zip(sums, more, strict=True)]
        new = [[s // n for s in sums] if n else old for (*sums, n), old in zip(totals, centroids, strict=True)]
        moved = [i for i, (a, b) in enumerate(zip(new, centroids, strict=True)) if a != b]
        centroids = new
        if not moved:
            break
    inertias = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.expr("try_sum(distance)")).alias("inertia")).collect()}  # at most k rows
    whole = None if None in inertias.values() else sum(inertias.values())
    whole = None if whole is None or whole >= 1 << 63 else whole
    made = [(i, inertias.get(i), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    made = spark.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(made), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
