"""Near copies: groups of texts whose sets of word shingles are similar.

The links are all pairs with a Jaccard similarity of SIMILARITY or more, whatever the edits and the size of a group:
SimHash fingerprints of the texts' word sets meet by pigeonhole blocks and join most close copies cheaply; then the
prefix filter proposes every other pair that can be similar, of which those within one component by then need no test.
All candidates are verified alike, on the whole sets. A bucket of a shingle that many texts share is first dealt into
small groups at random, again and again, whose pairs join a family of copies long before all its pairs are tried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import columns, scratch, table, texts
from pagewatch.llm.simhash import buckets, components, links

#: Words of a shingle, the least Jaccard similarity of their sets, and how many fingerprints a text has.
SHINGLE, SIMILARITY, FINGERPRINTS = 5, 0.8, 2
#: Of one in HOT_SAMPLE texts, shingles in HOT or more are hot: they come last in the order of prefixes. The most hot ones.
HOT_SAMPLE, HOT, HOT_MOST = 8, 3, 250_000
#: A shingle's bucket with more open pairs than this for each of its texts is compared in random groups first, of about so many texts.
PAIRS_A_TEXT, GROUP = 64, 32
#: Bits of the filter that tells which texts' sets are wanted (8 MB, at any size of the input).
FILTER_BITS = 1 << 26
#: Texts that a task remembers to know repeated ones.
SEEN = 200_000


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets have at least that Jaccard similarity (two empty ones: 1)."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < least * len(b):
        return len(b) == 0
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return both >= least * (len(a) + len(b) - both)


def overlap_left(n: int, least: float = SIMILARITY) -> int:
    """Of n shingles, the fewest that a set of that similarity shares (the slack is for floating point)."""
    return int(np.ceil(least * n - 1e-6))


def prefix(own: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set by one order for all sets: by hash, and then the hot ones by rank.

    Of two sets similar by SIMILARITY, both prefixes hold a common shingle. hot is sorted.
    """
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        is_hot = hot[at] == own
        last = at[is_hot]
        own = np.concatenate([own[~is_hot], hot[last[np.argsort(rank[last])]]])
    return own[: len(own) - overlap_left(len(own)) + 1]


def sketch(words: set[bytes], seeds: int = FINGERPRINTS) -> list[int]:
    """SimHash fingerprints of a set of words, one for each seed."""
    if not words:
        return [0] * seeds
    raw = b"".join(xxhash.xxh3_128_digest(w, seed) for seed in range((seeds + 1) // 2) for w in words)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, len(words), 16), axis=2)
    major = np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > len(words), axis=1)
    return major.reshape(-1).view("<i8")[:seeds].tolist()


def node_of(text: Column) -> Column:
    """A text's node: 16 bytes of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256), 1, 32))


def _node(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def _short_of(node: Column | str) -> Column:
    return F.conv(F.substring(F.hex(node), 1, 16), 16, -10).cast("long")


class _Seen:
    """Which of a task's texts have come before; it forgets them when they are SEEN."""

    def __init__(self) -> None:
        self.nodes: set[bytes] = set()

    def __call__(self, node: bytes) -> bool:
        if node in self.nodes:
            return True
        if len(self.nodes) >= SEEN:
            self.nodes.clear()
        self.nodes.add(node)
        return False


def hot_shingles(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hot shingles, sorted, and their ranks: the rarer, the earlier. They set an order, and so never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for _, found in columns(batches):
            some = [shingles(t) for t in found if not xxhash.xxh3_64_intdigest(t) % HOT_SAMPLE and not seen(_node(t))]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], ["h"])

    counts = own.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    hottest = counts.orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hottest)
    return hottest[order], len(hottest) - order


def sketches(own: DataFrame, hot: Broadcast) -> DataFrame:
    """doc_id, node, n (shingles), fps, prefix; the last three are null where a task has met the text before. hot: of hot_shingles()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch, found in columns(batches):
            nodes, made = [_node(t) for t in found], []
            for node, t in zip(nodes, found, strict=True):
                if seen(node):
                    made.append((None, None, None))
                else:
                    own_set = shingles(t)
                    made.append((len(own_set), sketch(set(t.lower().split())), prefix(own_set, *hot.value).view(np.int64) if len(own_set) else None))
            sizes, fps, prefixes = zip(*made, strict=True)
            arrays = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "node", "n", "fps", "prefix"])

    return own.mapInArrow(run, "doc_id long, node binary, n long, fps array<long>, prefix array<long>")


def _wanted(shorts: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, of which those of the shorts are set."""
    bit = shorts.select((F.pmod("short", F.lit(FILTER_BITS)) + 1).alias("bit"))  # Spark numbers bits and parts from 1
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in parts.collect():  # at most FILTER_BITS / 32768 rows of 4 kB
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def verified(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """hi, lo: the nodes of those pairs (a, b: shorts) whose sets are similar. Each set goes to the pairs of its text."""
    with scratch(own.sparkSession):
        pairs = table(pairs.where("a <> b").distinct(), "pairs")
        wanted = own.sparkSession.sparkContext.broadcast(_wanted(pairs.select(F.explode(F.array("a", "b")).alias("short"))))
        try:
            return table(_similar_pairs(own, pairs, wanted), "near-links", keep=True)
        finally:
            wanted.destroy()


def _similar_pairs(own: DataFrame, pairs: DataFrame, wanted: Broadcast) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = _Seen(), wanted.value
        for _, found in columns(batches):
            made = []
            for t in found:
                node = _node(t)
                bit = _short(node) % FILTER_BITS
                if bits[bit // 8] >> bit % 8 & 1 and not seen(node):
                    made.append((_short(node), node, shingles(t).tobytes()))
            if made:
                short, node, body = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64()), pa.array(node, pa.binary()), pa.array(body, pa.binary())], ["short", "node", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("node_a", "body_a", "node_b", "body_b")), strict=True)
            near = [(max(a, b), min(a, b)) for a, x, b, y in rows if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in near], pa.binary()) for i in (0, 1)], ["hi", "lo"])

    bodies = table(own.mapInArrow(sets, "short long, node binary, body binary").groupBy("short", "node").agg(F.first("body").alias("body")), "shingle-sets")
    one, two = (bodies.select(F.col("short").alias(c), F.col("node").alias(f"node_{c}"), F.col("body").alias(f"body_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("node_a", "body_a", "node_b", "body_b")
    return both.mapInArrow(compare, "hi binary, lo binary").distinct()


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: pairs that join all texts (node, n, fps) with a chain of fingerprints of one seed within the distance of a link."""
    prints = table(nodes.select(_short_of("node").alias("short"), "n", F.posexplode("fps").alias("seed", "fp")), "sketch-prints")
    own = table(prints.groupBy("seed", "fp").agg(F.min("short").alias("rep"), F.count("*").alias("texts")), "sketch-distinct")
    pairs = links(buckets(own.select("seed", "fp")))
    high, low = (own.select("seed", F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("hi", "lo"))
    edges = pairs.join(high, ["seed", "hi"]).join(low, ["seed", "lo"]).select(F.col("hi_rep").alias("a"), F.col("lo_rep").alias("b"))
    same = prints.join(own.where("texts > 1").select("seed", "fp", "rep"), ["seed", "fp"]).select(F.col("short").alias("a"), F.col("rep").alias("b"))
    return edges.unionByName(same)


MET = ["h", "short", "size"]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, short, size; sorted) whose h has two or more texts, each once; only the last row is held from batch to batch."""
    held, sent = np.zeros((0, len(MET)), np.int64), False
    for batch in batches:
        x = np.concatenate([held, np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in MET], axis=1)])
        x = x[np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)]] if len(x) else x
        if not len(x):
            continue
        like = x[1:, 0] == x[:-1, 0]
        out = np.r_[False, like] | np.r_[like, False]
        held, last = x[-1:], bool(out[-1]) or (len(x) == 1 and sent)
        out[0] &= not sent
        sent = last
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(x[out].T)], MET)


def prefix_rows(rows: DataFrame) -> DataFrame:
    """h, short, n, p: texts by the shingles of their prefixes and the places of these, where a shingle has two texts or more."""
    size = F.shiftleft("n", 32) + F.col("p")  # one number, as these rows are many
    each = rows.select(F.posexplode("prefix").alias("p", "h"), _short_of("node").alias("short"), "n").select("h", "short", size.alias("size"))
    met = each.repartition("h").sortWithinPartitions("h", "short").mapInArrow(_repeated, "h long, short long, size long")
    return met.select("h", "short", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(F.lit((1 << 32) - 1)).alias("p"))


def _enough(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose prefixes share enough for the sets to be similar; held: short, n, hs (the text's rows of prefix_rows()).

    What two sets share after the prefix that ends first is less than SIMILARITY of the larger one.
    """
    one, two = (held.select(F.col("short").alias(c), F.col("n").alias(f"n_{c}"), F.col("hs").alias(f"hs_{c}")) for c in "ab")
    both = F.size(F.array_intersect("hs_a", "hs_b")) + F.ceil(SIMILARITY * F.greatest("n_a", "n_b") - 1e-6) - 1
    found = pairs.distinct().join(one, "a").join(two, "b")
    return found.where(both >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b")


def _with_components(met: DataFrame, root: DataFrame) -> DataFrame:
    joined = root.select(_short_of("node").alias("short"), _short_of("root").alias("comp"))
    return met.select("h", "short", "n", "p").join(joined, "short", "left").withColumn("comp", F.coalesce("comp", "short"))


def _open(met: DataFrame, root: DataFrame) -> DataFrame:
    """h, short, n, p, comp, all, pairs, hot: the rows of met whose h may join components; its texts, and at most how many pairs it gives."""
    met = table(_with_components(met, root), "prefix-components")
    size = met.groupBy("h", "comp").agg(F.count("*").cast("double").alias("s"), F.count_if(_early("p", "n")).cast("double").alias("e"))
    size = size.groupBy("h").agg(F.count("*").alias("comps"), F.sum("s").alias("all"), F.sum("e").alias("early"), F.sum(F.col("s") * F.col("e")).alias("own"))
    size = size.where("comps > 1 AND early > 0").select("h", "all", (F.col("all") * F.col("early") - F.col("own")).alias("pairs"))
    return table(met.join(size.withColumn("hot", F.col("pairs") > PAIRS_A_TEXT * F.col("all")), "h"), "prefix-open")


def _early(p: str, n: str) -> Column:
    """Whether a set's shingle at place p can be the first that it shares with a similar set of its size or larger."""
    return F.col(p) <= (1 - 2 * SIMILARITY / (1 + SIMILARITY)) * F.col(n) + 1e-6


def _pairs(rows: DataFrame, *on: str) -> DataFrame:
    """a, b: the pairs of texts in different components, of like sizes, that can be similar if the shingle is the first that they share.

    a is the smaller set, or of sets of one size the one of less number.
    """
    one, two = (rows.select(*on, *(F.col(c).alias(f"{c}_{k}") for c in ("short", "n", "p", "comp"))) for k in "ab")
    pairs = one.where(_early("p_a", "n_a")).join(two, list(on)).where("n_a < n_b OR n_a = n_b AND short_a < short_b").where("comp_a <> comp_b")
    pairs = pairs.where(F.col("n_a") >= SIMILARITY * F.col("n_b") - 1e-6)
    left = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    pairs = pairs.where(left >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    return pairs.select(F.col("short_a").alias("a"), F.col("short_b").alias("b"))


def _group_pairs(hot: DataFrame, turn: int) -> DataFrame:
    """a, b: the pairs within random groups of about GROUP texts of each hot bucket, others at each turn."""
    group = F.pmod(F.xxhash64("short", "h", F.lit(turn)), F.ceil(F.col("all") / GROUP)).alias("group")
    return _pairs(hot.select("*", group), "h", "group")


def _joined(root: DataFrame, more: DataFrame) -> DataFrame:
    """The components of root (node, root) once more links (hi, lo) are there."""
    if more.isEmpty():
        return root
    return table(components(root.select(F.col("node").alias("hi"), F.col("root").alias("lo")).unionByName(more)), "near-components")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, node, keep_id for the rows of docs in groups of two or more different texts; keep_id: the group's smallest doc_id.

    A group is a component of all pairs of texts whose sets of SHINGLE-word shingles have a Jaccard similarity of
    SIMILARITY or more (but for collisions of 64-bit hashes). Words are lower-cased and parted by ASCII blanks. Null texts
    count as empty, and all texts without words are alike. Equal texts are one node; repeated rows come back as often as
    they are given. A null doc_id never is a keep_id unless its group has no other. Texts of any length are taken whole.
    Empty tables give empty results; extra columns, whatever their names, are ignored.
    """
    with scratch(docs.sparkSession):
        return table(_near_copies(docs), "near-copies", keep=True)


def _near_copies(docs: DataFrame) -> DataFrame:
    own = texts(docs)
    hot = own.sparkSession.sparkContext.broadcast(hot_shingles(own))
    rows = table(sketches(own, hot), "sketches")
    hot.destroy()
    prints = [F.max(F.col("fps")[i]) for i in range(FINGERPRINTS)]
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), *(p.alias(f"fp{i}") for i, p in enumerate(prints)))
    nodes = table(nodes.select("node", "first", "n", F.array(*(f"fp{i}" for i in range(FINGERPRINTS))).alias("fps")), "sketch-nodes")
    root = table(components(verified(own, simhash_pairs(nodes))), "near-components")
    met = table(prefix_rows(rows), "prefix-rows")
    held = table(met.groupBy("short").agg(F.max("n").alias("n"), F.collect_list("h").alias("hs")), "prefix-texts")
    rest = _open(met, root)
    cold, hot, before, turn = [rest.where("NOT hot")], rest.where("hot"), None, 0
    while True:
        pairs = hot.select("h", "pairs").distinct().agg(F.sum("pairs")).first()[0]
        if not pairs or before is not None and pairs > 0.9 * before:
            break
        before, turn = pairs, turn + 1
        root = _joined(root, verified(own, _enough(_group_pairs(hot, turn), held)))
        rest = _open(hot, root)
        cold, hot = [*cold, rest.where("NOT hot")], rest.where("hot")
    rest = table(_with_components(reduce(DataFrame.unionByName, [hot, *cold]), root), "prefix-rest")
    root = _joined(root, verified(own, _enough(_pairs(rest, "h"), held)))
    root = table(root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()), "near-copies")
    kept = root.join(nodes.select("node", "first"), "node")
    least = kept.groupBy("root").agg(F.min("first").alias("keep_id"))
    return rows.select("doc_id", "node").join(kept.join(least, "root").select("node", "keep_id"), "node").select("doc_id", "node", "keep_id")
