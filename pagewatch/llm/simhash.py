"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming links, components.

Two fingerprints at distance d agree on at least b - d of b blocks. With five blocks and d <= 3, every
linked pair agrees on two of them, so the ten pairs of blocks are the join keys (25 or 26 bits each: the
candidates stay few as the corpus grows). A bucket of one key never lands whole in a task when it is
large: it is split again, by four parts of the bits its key leaves free, of which three flipped bits
spare one. Each round fixes a quarter of the free bits, so that a bucket's size is bounded by the bits left.
Inside a bucket a search emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import columns, table, texts

#: Words of a shingle, and the most differing bits of a link, by the query's contract.
WORDS, DISTANCE = 3, 3
SEED = 42
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket that one task compares; larger buckets are split further.
BUCKET = 1024
BUCKET_KEY = ("seed", "mask", "val")
_CHUNK = 1 << 16



def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as a signed 64-bit integer; 0 where the text has no words."""
    found = text.lower().split()  # bytes: only A-Z change, and only the six ASCII blanks separate
    if not found:
        return 0
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    counts, total = np.zeros(64, np.int64), len(found) - words + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        part = found[at : at + _CHUNK + words - 1]
        grams = part if words == 1 else map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        hashes = np.fromiter((digest(g, seed) for g in grams), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp: one row for each row of docs. A null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in columns(batches):
            fps = pa.array((fingerprint(t, words, seed) for t in found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks() -> list[int]:
    single, at = [], 0
    for width in BLOCKS:
        single.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(single, len(BLOCKS) - DISTANCE)]


def _split_mask(mask: int) -> list[int]:
    """mask with each of DISTANCE + 1 parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i :: DISTANCE + 1]) for i in range(DISTANCE + 1)]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    made = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("val")) for m in masks]
    return fps.select("seed", "fp", F.inline(F.array(*made)))


def bucket_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search over those unseen."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                got = rest[near]
                left.append(np.full(len(got), x, np.uint64))
                right.append(got)
                queue.extend(got)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets; rows come sorted by BUCKET_KEY, and a bucket may go over batches."""

    def emit(seed: np.ndarray, mask: np.ndarray, val: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        starts = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]  # most buckets: compared all at once
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE
        found = [(seed[two][near], fp[two][near], fp[two + 1][near])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            a, b = bucket_links(fp[s : s + n])
            found.append((np.full(len(a), seed[s]), a, b))
        own, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = a.view(np.int64), b.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["seed", "hi", "lo"])

    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    for batch in batches:
        new = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (*BUCKET_KEY, "fp")]
        seed, mask, val, fp = (np.concatenate(x) for x in zip(held, [*new[:3], new[3].view(np.uint64)], strict=True))
        if not len(fp):
            continue
        whole = int(np.argmax((seed == seed[-1]) & (mask == mask[-1]) & (val == val[-1])))  # the last bucket may go on
        yield from emit(seed[:whole], mask[:whole], val[:whole], fp[:whole])
        held = [seed[whole:], mask[whole:], val[whole:], fp[whole:]]
    yield from emit(*held)


def buckets(fps: DataFrame) -> DataFrame:
    """seed, mask, val, fp: distinct fingerprints (seed, fp) in buckets of two to BUCKET.

    Any two fingerprints of one seed within DISTANCE share a bucket. Larger buckets are split until none is left.
    """
    masks, found = _block_masks(), None
    keyed = _keyed(fps, masks)
    while True:
        sizes = table(keyed.groupBy(*BUCKET_KEY).agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        small = keyed.join(sizes.where(F.col("n") <= BUCKET).drop("n"), list(BUCKET_KEY))
        found = small if found is None else found.unionByName(small)
        large = sizes.where(F.col("n") > BUCKET).drop("n")
        if large.isEmpty():
            return found.select(*BUCKET_KEY, "fp")
        by_mask = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(s)) for s in _split_mask(m))))))
        split = keyed.join(large, list(BUCKET_KEY)).select("seed", "fp", F.explode(by_mask[F.col("mask")]).alias("mask"))
        keyed = table(split.select("seed", "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val")).distinct(), "simhash-split")
        masks = sorted({s for m in masks for s in _split_mask(m)})


def links(found: DataFrame) -> DataFrame:
    """seed, hi, lo of buckets(...): links that keep the components of all links within DISTANCE of one seed."""
    ordered = found.repartition(*BUCKET_KEY).sortWithinPartitions(*BUCKET_KEY).select(*BUCKET_KEY, "fp")
    return ordered.mapInArrow(_links_of_sorted, "seed int, hi long, lo long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (hi, lo: hi > lo) the smallest node that it reaches.

    Alternating large-star and small-star rounds until the edges are stars; each round is a minimum per
    node and a join, so that no task holds a node's neighbours.
    """

    def are_stars(e: DataFrame) -> bool:
        ends = e.select(F.inline(F.array(F.struct(F.col("hi").alias("u"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("u"), F.lit(0).alias("up")))))
        ends = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        return ends.where("ups > 1 OR ups > 0 AND least = 0").isEmpty()  # two roots, or a root that is no end

    edges = table(edges.where("hi <> lo").distinct(), "components")
    while not are_stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components")  # written, so that Spark can split the join's hot nodes
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = table(large, "components")
        least = table(large.groupBy("hi").agg(F.min("lo").alias("m")), "components")
        small = large.join(least, "hi").select(F.inline(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))))
        edges = table(small.where("hi <> lo").distinct(), "components")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id: component_id is the smallest doc_id that links reach, the document's own included.

    Null texts count as empty; texts without words have fingerprint 0 and link like any other. Repeated
    rows come back as often as they are given; a null doc_id stays null and never names a component
    unless it is alone in it. Texts of any length are taken whole, a stretch of shingles at a time. An empty table
    gives an empty result. Other columns of docs are ignored.
    """
    rows = table(fingerprints(docs, words, seed), "fingerprints")
    own = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    root = components(links(buckets(own.select(F.lit(0).alias("seed"), "fp"))).select("hi", "lo"))
    rooted = own.join(root, own.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = table(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
