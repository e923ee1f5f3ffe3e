"""Exact dedup by a minimal perfect hash over historical distinct digests.

History's distinct SHA-256 digests are dealt by digest into shards of bounded size; each shard is one
row of an index: a minimal perfect hash (levels of bit arrays: a digest goes to the first level where its
bit is its own), and by its numbers the slots, which hold the full digests, the winners' doc_ids and the
sizes. New texts are first grouped by digest (partial aggregation, so that hot texts stay small), then
looked up: the slot's digest is compared byte by byte, since a perfect hash gives strangers a slot too.
Members join their slot's winner; nonmembers are groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import table

#: Digests of a shard on average; a shard is built and searched in one task.
SHARD = 50_000
#: Bits of a level per digest that is left.
GAMMA = 2
#: Levels of bit arrays; the digests that none takes are listed.
LEVELS = 24
#: Stands for a null doc_id in a slot.
NONE = np.iinfo(np.int64).min

INDEX = "shard long, n long, sizes array<long>, bits binary, slots binary, winners binary, counts binary"
GROUPS = "digest binary, keep_id long, group_size long"


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest's first 16 bytes (two words) for a level."""
    x = keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1)) ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Numbers n distinct 32-byte digests 0 to n - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.ranks = np.r_[0, np.cumsum(bits, dtype=np.int64)]

    @classmethod
    def build(cls, slots: np.ndarray) -> PerfectHash:
        """slots: (n, 32) bytes, all rows distinct."""
        keys, sizes, levels = slots[:, :16].copy().view("<u8"), [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = GAMMA * len(keys)
            at = (_level_hash(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def number(self, slots: np.ndarray) -> np.ndarray:
        """Of each digest; strangers get some number too, or that of the first unlisted digest."""
        keys = slots[:, :16].copy().view("<u8")
        out, left = np.full(len(keys), self.ranks[-1], np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_level_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
            own = self.bits[at]
            out[left[own]] = self.ranks[at[own]]
            left = left[~own]
        return out


def _matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def build_shard(digests: list[bytes], winners: np.ndarray, counts: np.ndarray) -> dict:
    """A row of the index. Digests that no level takes follow the numbered ones, in any order."""
    slots = _matrix(digests)
    hashed = PerfectHash.build(slots)
    number = hashed.number(slots)
    unlisted = np.flatnonzero(number == hashed.ranks[-1])
    number[unlisted] = hashed.ranks[-1] + np.arange(len(unlisted))
    order = np.argsort(number)
    return {
        "n": len(digests), "sizes": hashed.sizes, "bits": np.packbits(hashed.bits).tobytes(), "slots": slots[order].tobytes(),
        "winners": winners[order].astype("<i8").tobytes(), "counts": counts[order].astype("<i8").tobytes(),
    }


class Shard:
    def __init__(self, row: dict):
        self.slots = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)
        self.winners, self.counts = (np.frombuffer(row[k], "<i8").copy() for k in ("winners", "counts"))
        sizes = list(row["sizes"])
        self.hashed = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool))
        self.unlisted = {self.slots[i].tobytes(): i for i in range(int(self.hashed.ranks[-1]), len(self.slots))}

    def find(self, slots: np.ndarray) -> np.ndarray:
        """The slot that holds each digest, checked over all its bytes; -1: not a member."""
        if not len(self.slots) or not len(slots):
            return np.full(len(slots), -1)
        at = self.hashed.number(slots)
        out = np.where((at < len(self.slots)) & (self.slots[np.minimum(at, len(self.slots) - 1)] == slots).all(axis=1), at, -1)
        if self.unlisted:
            for i in np.flatnonzero((out < 0) & (at == self.hashed.ranks[-1])):
                out[i] = self.unlisted.get(slots[i].tobytes(), -1)
        return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes of the text in UTF-8; null: empty)."""
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)).alias("digest"))


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    groups = rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(int(NONE))).alias("winner"), F.count("*").alias("n"))
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: doc_id, digest. A row (INDEX) for each shard that has digests."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = build_shard(rows["digest"].tolist(), rows["winner"].to_numpy(), rows["n"].to_numpy())
        return pd.DataFrame([{"shard": int(key[0])} | made])

    return _grouped(history, shards).groupBy("shard").applyInPandas(run, INDEX)


def look_up(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """GROUPS over history and incoming together: a row for each distinct digest of either."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.column("digest").to_pylist()
        new, winner, n = _matrix(found), right.column("winner").to_numpy(), right.column("n").to_numpy()
        if left.num_rows:
            shard = Shard(left.to_pylist()[0])
            at = shard.find(new)
            member = at >= 0
            np.maximum.at(shard.winners, at[member], winner[member])
            np.add.at(shard.counts, at[member], n[member])
            found = [bytes(x) for x in shard.slots] + [x for x, known in zip(found, member, strict=True) if not known]
            winner, n = np.r_[shard.winners, winner[~member]], np.r_[shard.counts, n[~member]]
        return pa.table({"digest": pa.array(found, pa.binary()), "keep_id": pa.array(winner, pa.int64(), mask=winner == NONE), "group_size": pa.array(n, pa.int64())})

    return index.groupBy("shard").cogroup(_grouped(incoming, shards).groupBy("shard")).applyInArrow(run, GROUPS)


def exact_duplicates(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """GROUPS for the texts of two tables of documents: the registered history and what comes in. Either may be empty; nulls as in dedup()."""
    return _groups(table(digests(history), "history-digests"), table(digests(incoming), "incoming-digests"))


def _groups(history: DataFrame, incoming: DataFrame) -> DataFrame:
    parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(2 * parts, -(-(history.count() + incoming.count()) // SHARD))
    index = table(build_index(history, shards), "digest-index")
    return look_up(index, incoming, shards)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size per row of docs: of equal texts the largest doc_id stays.

    The lower half of the range of doc_ids is the history that the index is built over; the rest comes
    in. A null text counts as empty. A null doc_id belongs to the rows that come in and stays only if its whole
    group has none (keep_id is null then). Repeated rows each count in group_size and come back each. An
    empty table gives an empty result. Texts of any length are hashed whole. Other columns of docs are ignored.
    """
    rows = table(digests(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(0 if low is None else (low + high) // 2)
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    groups = table(_groups(rows.where(old), rows.where(~old)), "digest-groups")
    return rows.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
