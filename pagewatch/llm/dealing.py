"""Values of a corpus's distinct keys: found once a key, and sent back to every block that holds it.

A block's distinct keys lie in cells by hash, at most CELLS of them however large the corpus is. Up to CELLS shards, a
shard gathers whole cells. Beyond, blocks are dealt twice: a bundle of blocks merges each of its cells, and deals the merged keys
into finer cells, which are looked up; the answers go back the same way. Shards follow from the number of keys to look up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import table

#: Cells of a block, of which each holds a part of its keys.
CELLS = 256
#: Keys, counted once a block, that a shard takes; blocks of a bundle.
SHARD, BUNDLE = 1 << 20, 64

#: What a block asks: parts of its distinct keys, with a weight each, in the order of the cells.
ASKED = "array<struct<cell:int,n:int,keys:binary,weights:binary>>"
ASKED_ARROW = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("weights", pa.binary())]))

#: Of distinct keys and the sums of their weights, an integer for each key and, for the caller, a summary of the shard.
Answer = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, bytes | None]]


def pack(x: np.ndarray, kind: str) -> bytes:
    """Integers as compressed byte planes."""
    flat = np.ascontiguousarray(x, np.dtype(kind))
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return raw.reshape(dtype.itemsize, -1).T.copy().view(dtype).reshape(-1)


def pack_keys(keys: list[bytes]) -> bytes:
    sizes = pack(np.array([len(k) for k in keys]), "<u4")
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=1).compress(b"".join(keys))


def unpack_keys(body: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(body[:4], "little")
    ends = np.cumsum(unpack(body[4:cut], "<u4")).tolist()
    raw = zstandard.ZstdDecompressor().decompress(body[cut:]) if ends and ends[-1] else b""
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def coded(keys: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each key's number among the distinct ones, and these."""
    found = pa.array(keys, pa.large_binary()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def dealt(keys: list[bytes], weights: np.ndarray, cells: int, seed: int = 0) -> tuple[np.ndarray, list[dict]]:
    """Each key's rank in the order of the cells, and the cells that aren't empty."""
    cell = np.fromiter((xxhash.xxh32_intdigest(k, seed) % cells for k in keys), np.int64, len(keys))
    order = np.argsort(cell, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    found, starts = np.unique(cell[order], return_index=True)
    ends = [*starts[1:], len(order)]
    return rank, [{"cell": int(c), "n": int(b - a), "keys": pack_keys([keys[i] for i in order[a:b]]), "weights": pack(weights[order[a:b]], "<i8")} for c, a, b in zip(found, starts, ends, strict=False)]


def _gathered(rows: pa.Table) -> tuple[list[int], np.ndarray, list[bytes], np.ndarray]:
    """Sizes of the rows, the number of each of their keys among the distinct ones, these, and their summed weights."""
    codes, distinct = coded([k for body in rows.column("keys").to_pylist() for k in unpack_keys(body)])
    weights = np.concatenate([unpack(w, "<i8") for w in rows.column("weights").to_pylist()])
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, codes, weights)
    return rows.column("n").to_pylist(), codes, distinct, total


def _answer(answer: Answer, names: list[str]):
    """Answers each row of a shard, and adds a row without `names` for the shard's summary."""

    def run(rows: pa.Table) -> pa.Table:
        n, codes, distinct, total = _gathered(rows)
        values, summary = answer(distinct, total)
        parts = np.split(values[codes], np.cumsum(n)[:-1])
        out = {name: rows.column(name).to_pylist() for name in names} | {"values": [pack(p, "<i8") for p in parts]}
        if summary is not None:
            out = {name: [*found, summary if name == "values" else None] for name, found in out.items()}
        kinds = {"block": pa.int64(), "bundle": pa.int64(), "values": pa.binary()}
        return pa.table({name: pa.array(found, kinds.get(name, pa.int32())) for name, found in out.items()})

    return run


def _merge(cells: int):
    """A bundle's cell: which merged key each block's keys are, and the merged keys dealt into finer cells."""

    def run(rows: pa.Table) -> pa.Table:
        n, codes, distinct, total = _gathered(rows)
        rank, fine = dealt(distinct, total, cells, 1)
        parts = np.split(rank[codes], np.cumsum(n)[:-1])
        back = [{"block": b, "codes": pack(p, "<u4")} for b, p in zip(rows.column("block").to_pylist(), parts, strict=True)]
        return pa.table({
            "cell": pa.array(rows.column("cell").to_pylist()[:1], pa.int32()), "bundle": pa.array(rows.column("bundle").to_pylist()[:1], pa.int64()),
            "back": pa.array([back], pa.list_(pa.struct([("block", pa.int64()), ("codes", pa.binary())]))), "fine": pa.array([fine], ASKED_ARROW),
        })

    return run


def _back(left: pa.Table, right: pa.Table) -> pa.Table:
    """The answers to a bundle's cell, for each of its blocks."""
    found = sorted(zip(right.column("part").to_pylist(), right.column("values").to_pylist(), strict=True))
    values = np.concatenate([unpack(v, "<i8") for _, v in found])
    back, cell = left.column("back").to_pylist()[0], left.column("cell").to_pylist()[0]
    return pa.table({
        "block": pa.array([b["block"] for b in back], pa.int64()), "cell": pa.array([cell] * len(back), pa.int32()),
        "values": pa.array([pack(values[unpack(b["codes"], "<u4")], "<i8") for b in back], pa.binary()),
    })


def answered(made: DataFrame, answer: Answer, shard: int = SHARD, bundle: int = BUNDLE) -> DataFrame:
    """block, cell, values (packed) of each cell of made (a written table with block and asked); a summary has no block."""
    asked = made.select("block", F.inline("asked"))
    size = made.select("block", F.aggregate("asked.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    shards = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.n or 0) // shard))
    if shards <= CELLS:
        return asked.groupBy((F.col("cell") % shards).alias("shard")).applyInArrow(_answer(answer, ["block", "cell"]), "block long, cell int, values binary")
    fine = -(-shards // CELLS)
    bundles = -(-size.blocks // bundle)
    merged = asked.withColumn("bundle", F.pmod("block", F.lit(bundles))).groupBy("cell", "bundle").applyInArrow(_merge(fine), f"cell int, bundle long, back array<struct<block:long,codes:binary>>, fine {ASKED}")
    merged = table(merged, "bundles")
    parts = merged.select("cell", "bundle", F.inline("fine").alias("part", "n", "keys", "weights"))
    found = table(parts.groupBy("cell", "part").applyInArrow(_answer(answer, ["cell", "bundle", "part"]), "cell int, bundle long, part int, values binary"), "bundle-answers")
    back = merged.select("cell", "bundle", "back").groupBy("cell", "bundle").cogroup(found.where("part is not null").groupBy("cell", "bundle"))
    whole = back.applyInArrow(_back, "block long, cell int, values binary")
    return whole.unionByName(found.where("part is null").selectExpr("cast(null as long) block", "cast(null as int) cell", "values"))


def values_of(rows: pa.Table) -> np.ndarray:
    """A block's answers in the order of its ranks, from its rows of answered()."""
    found = sorted(zip(rows.column("cell").to_pylist(), rows.column("values").to_pylist(), strict=True))
    return np.concatenate([unpack(v, "<i8") for _, v in found]) if found else np.zeros(0, np.int64)
