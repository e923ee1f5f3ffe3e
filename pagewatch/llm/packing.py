"""Packing into sequences of at most LIMIT tokens: first-fit decreasing in randomised groups of documents.

Documents go to groups by hash; each group is tokenised and packed by one task. A document's whole
sequences are cut off first; what is left of each goes, longest first, into the first bin with room, found
through a tournament tree of the bins' room. Bins that stay far from full are topped up by cutting up the
emptiest ones, and the last bin of a group is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.pretokens import PreTokenizer, coded
from pagewatch.llm.shared import texts
from pagewatch.llm.token_counts import scan_parts

LIMIT = 1024
#: Fewest tokens of room worth a cut.
TOP_UP = 16
#: Bytes of input files (compressed) that a group stands for, about a third of its text.
GROUP_BYTES = 4 << 20
#: Pre-tokens whose ids a worker remembers.
MEMO = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins by number; every inner node has the greatest room of its bins."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with so much room; there must be one."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        return node - self.leaves

    def take(self, bin_: int, need: int) -> None:
        node, room = bin_ + self.leaves, self.room
        room[node] -= need
        while node > 1:
            node >>= 1
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most


def first_fit_decreasing(sizes: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Items by bin; sizes are 1 to limit."""
    tree, bins = Tournament(len(sizes), limit), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = tree.first(size)
        tree.take(at, size)
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack(sizes: np.ndarray, limit: int = LIMIT, top_up: int = TOP_UP) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) of items of any sizes; each token lies in exactly one."""
    out = [[(i, at, limit)] for i, n in enumerate(sizes.tolist()) for at in range(0, n - limit + 1, limit)]
    rest = np.flatnonzero(sizes % limit)
    bins = [[(int(rest[k]), int(sizes[rest[k]] // limit * limit), int(sizes[rest[k]] % limit)) for k in b] for b in first_fit_decreasing(sizes[rest] % limit, limit)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    last = len(bins) - 1
    for at, own in enumerate(bins):
        fill = sum(p[2] for p in own)
        if limit - fill < top_up or at >= last or not fill & (fill - 1):
            continue
        while fill < limit and last > at:
            item, start, length = bins[last].pop()
            take = min(length, limit - fill)
            own.append((item, start + length - take, take))
            fill += take
            if take < length:
                bins[last].append((item, start, length - take))
            elif not bins[last]:
                last -= 1
    for own in bins[: last + 1]:
        fill = sum(p[2] for p in own)
        out += [own] if limit - fill < top_up or not fill & (fill - 1) else _powers(own)
    return out


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    left, out, pieces = sum(p[2] for p in pieces), [], pieces[::-1]
    while left:
        want = 1 << left.bit_length() - 1
        left -= want
        own = []
        while want:
            item, start, length = pieces.pop()
            take = min(length, want)
            own.append((item, start, take))
            want -= take
            if take < length:
                pieces.append((item, start + take, length - take))
        out.append(own)
    return out


class Encoder:
    """Ids of many texts at a time, through the ids of their distinct pre-tokens."""

    def __init__(self, vocabulary: str, words: bool = False, end: int = 0):
        self.splitter, self.end, self.memo = PreTokenizer(vocabulary, words), end, {}

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (little-endian 32-bit, each text closed by `end`) in order, and where each text starts (and the last ends)."""
        tokens, owner = self.splitter.split(found)
        codes, distinct = coded(tokens)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = [w for w in distinct if w not in memo]
        for w, ids in zip(new, self.splitter.ids(new), strict=True):
            memo[w] = array("I", ids).tobytes()
        parts = [memo[w] for w in distinct]
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        if (owner[1:] < owner[:-1]).any():  # texts that went through the library come last
            order = np.argsort(owner, kind="stable")
            codes, owner = codes[order], owner[order]
        lens = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        per_text = np.bincount(owner, lens, len(found)).astype(np.int64) + 1 if len(codes) else np.ones(len(found), np.int64)
        edge = np.r_[0, np.cumsum(per_text)]
        total = int(lens.sum())
        source = np.repeat((starts[codes] if len(codes) else lens) - (np.cumsum(lens) - lens), lens) + np.arange(total)
        ids = np.full(edge[-1], self.end, "<u4")
        own = np.ones(edge[-1], bool)
        own[edge[1:] - 1] = False
        ids[own] = flat[source]
        return ids, edge


_encoders: dict[str, Encoder] = {}


def _pack_group(vocabulary: str, end: int, limit: int, top_up: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        encoder = _encoders.setdefault(f"{vocabulary} {end}", Encoder(vocabulary, end=end))
        ids, edge = encoder.ids(rows.column("text").to_pylist())
        sizes = np.diff(edge)
        out, view = [], memoryview(ids).cast("B")
        for number, pieces in enumerate(pack(sizes, limit, top_up)):
            at = 0
            for item, start, length in pieces:
                a = 4 * int(edge[item] + start)
                out.append((item, start, length, zlib.crc32(view[a : a + 4 * length]), number, at))
                at += length
        item, start, length, crc, number, offset = (np.array(x, np.int64) for x in zip(*out, strict=True))
        group = key[0].as_py()
        return pa.table({
            "doc_id": rows.column("doc_id").take(pa.array(item)), "start": start, "length": length, "ids_crc32": crc,
            "doc_tokens": sizes[item].astype(np.int64), "sequence_id": (group << 32) + number, "offset": offset,
        })

    return run


def group_count(docs: DataFrame) -> int:
    """Groups of about GROUP_BYTES of the files that the plan reads, and one for each shuffle partition at least; runs nothing."""
    spark = docs.sparkSession
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    planned = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of a join it may be far too large
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(scan_parts(docs) * most, planned) // GROUP_BYTES))


def packed(docs: DataFrame, vocabulary: str, end: int = 0, limit: int = LIMIT, top_up: int = TOP_UP) -> DataFrame:
    """PIECES: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    A document is the library's ids of its whole text, then `end`; a null text counts as empty, so that
    every row of docs has a piece. Repeated rows are packed each; a null doc_id stays null. Groups are by
    a hash of doc_id and row, so that no key makes a group large. A text of any length is packed whole, by one task.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = texts(docs).withColumn("group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(group_count(docs))))
    return rows.groupBy("group").applyInArrow(_pack_group(vocabulary, end, limit, top_up), PIECES)
