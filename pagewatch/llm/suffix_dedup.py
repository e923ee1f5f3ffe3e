"""Repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes when a LENGTH-byte string that covers it also starts earlier. Equal strings have equal
minimizers (the least hash of their K-byte parts), so texts are cut into runs of string starts with one minimizer and
only runs whose minimizer stands in the corpus more than once go on: each as a snippet, to the shard of its minimizer.
A shard's distinct snippets make one text. Its BWT is searched backward breadth-first: intervals of
strings of 8, 9, ... bytes are extended by a byte to the left, each boundary between suffixes that an extension is the first to
find has that common prefix, and the search stops at LENGTH. Boundaries that are left separate suffixes that share LENGTH bytes.
The first string of each such class stays, and every other start is reported to its text.

1. blocks: some MB of texts each, written once.   2. keys: each block's distinct minimizers, by shard;
shards answer which ones repeat.   3. snippets: by block with the answers, dealt to shards.
4. removed starts: by shard.   5. what is left of each text: by block with the removed starts.
Minimizers of very many runs (HOT) don't gather their snippets: these fall apart into single strings,
dealt by their own hashes, of which equal ones collapse in every block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import columns, table, texts
from pagewatch.llm.token_counts import pack, scan_parts, unpack

#: Bytes of a string that must not repeat.
LENGTH = 100
#: Bytes of the parts that are hashed (a power of two).
K = 32
#: Bytes of text of a block, of a stretch that is hashed at once, and of the text of a BWT.
BLOCK, STRETCH, CHUNK = 4 << 20, 1 << 19, 1 << 17
#: Runs of one minimizer from which its snippets fall apart into single strings.
HOT = 4096
#: Bytes of the prefixes that the search starts from.
FIRST = 8

#: Bits of a minimizer's hash that are its key in a shard; the others deal it to one.
KEY_BITS = 40

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LAST = np.iinfo(np.int64).max


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX[5]
    return h ^ (h >> np.uint64(29))


def part_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-byte parts, by doubling."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    for mix in _MIX:
        if n == k:
            break
        h = h[:-n] * mix + (h[n:] ^ (h[n:] >> np.uint64(29)))
        n *= 2
    return _finish(h)


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Hashes of the whole strings at starts."""
    grid = data[starts[:, None] + np.arange(length)].astype(np.uint64)
    h = np.zeros(len(starts), np.uint64)
    for i in range(length):
        h = (h ^ grid[:, i]) * _MIX[0]
        h ^= h >> np.uint64(31)
    return _finish(h)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Of each width neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start (in data) and minimizer of each run; ends: where each text of data ends.

    A run's strings have their first least part at one place: it never leaves a text, has at most
    length - k + 1 starts, and no two equal strings.
    """
    width, found = length - k + 1, []
    begins = np.r_[0, ends[:-1]]
    bounds, at = [], 0  # stretches of whole texts, or of a text's pieces that overlap by length - 1
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        if end - at > STRETCH and begin > at:
            bounds.append((at, begin))
            at = begin
        while end - at > STRETCH:
            bounds.append((at, at + STRETCH))
            at += STRETCH - length + 1
    if len(ends):
        bounds.append((at, int(ends[-1])))
    for a, b in bounds:
        if b - a < length:
            continue
        h = part_hashes(data[a:b], k)
        m = least(h, width)
        text = np.searchsorted(ends, np.arange(a, a + len(m)), side="right")
        whole = np.arange(a, a + len(m)) + length <= ends[text]
        left = h[: len(m) - 1] == m[:-1]  # the next string has lost the part; an equal one further on begins a new run
        first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | left | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])])
        stop = np.r_[first[1:], len(m)] - 1
        keep = whole[first]
        found.append((first[keep] + a, stop[keep] + a, m[first[keep]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeats(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of text, and for each row whether its suffix shares length bytes with the one before.

    The order is that of the first 128 or 216 bytes, which the intervals of shorter strings depend on alone.
    """
    n = len(text)
    words = np.r_[text, np.zeros(FIRST, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        words = (words[:-step] << np.uint64(8 * step)) | words[step:]
    words = words[:n]
    order = np.argsort(words)
    known = np.r_[True, words[order[1:]] != words[order[:-1]]]
    head = known.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(known)
    ways, step = 3 if n < 1 << 21 else 2, FIRST
    while step < length and not head.all():
        key = np.zeros(n, np.int64)
        for i in range(ways):  # several ranks to a number: so many times the depth
            key[: max(n - i * step, 0)] |= rank[i * step :] << (63 // ways * (ways - 1 - i))
        order = np.argsort(key)
        found = key[order]
        head = np.r_[True, found[1:] != found[:-1]]
        rank[order] = np.cumsum(head)
        step *= ways
    before = text[order - 1]
    before[order == 0] = 255
    by_byte = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_byte] = np.arange(n)  # the row of the suffix one byte longer
    # known[x]: the common prefix of rows x - 1 and x is already found; intervals: of all strings of FIRST bytes
    known = np.r_[words[order[1:]] != words[order[:-1]], True]
    known = np.r_[True, known]
    lows = np.flatnonzero(known[:-1])
    highs = np.r_[lows[1:], n] - 1
    owner = np.empty(n, np.int64)
    for _ in range(FIRST, length):
        if not len(lows):
            break
        sizes = highs - lows + 1
        rows = np.repeat(lows - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owner[rows] = np.repeat(np.arange(len(lows)), sizes)
        longer = np.sort(back[rows])
        shorter = by_byte[longer]
        new = np.r_[True, (owner[shorter[1:]] != owner[shorter[:-1]]) | (before[shorter[1:]] != before[shorter[:-1]])]
        first = np.flatnonzero(new)
        lows, highs = longer[first], longer[np.r_[first[1:], len(longer)] - 1]
        fresh = ~known[highs + 1]
        lows, highs = lows[fresh], highs[fresh]
        known[highs + 1] = True
    return order, ~known[:-1]


def repeated_starts(snippets: list[bytes], order: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Of each snippet, which of its strings also start earlier: in a snippet of less order, or of the same order at a smaller start.

    order: of the snippets' documents. starts: each snippet's place in its document.
    """
    sizes = np.array([len(s) for s in snippets])
    text = np.frombuffer(b"\xff".join(snippets) + b"\xff", np.uint8)
    rows, same = repeats(text, length)
    group = np.empty(len(text), np.int64)
    group[rows] = np.cumsum(~same)
    counts = sizes - length + 1
    ends = np.cumsum(counts)
    own = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    place = np.repeat(np.cumsum(sizes + 1) - sizes - 1, counts) + own
    key = np.repeat(order.astype(np.int64) << 40, counts) + np.repeat(starts, counts) + own
    least_key = np.full(int(group.max()) + 1, _LAST)
    np.minimum.at(least_key, group[place], key)
    return np.split(key > least_key[group[place]], ends[:-1])


BLOCKS = "block long, meta binary, body binary"


def blocks(docs: DataFrame) -> DataFrame:
    """block, meta (doc_ids, null flags, lengths), body (the texts)."""

    def close(number: int, ids: list, found: list[bytes]) -> pa.RecordBatch:
        meta = pack(np.concatenate([[_LAST if i is None else i for i in ids], [i is None for i in ids], [len(t) for t in found]]), "<i8")
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(found))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([meta]), pa.array([body])], ["block", "meta", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        number = TaskContext.get().partitionId() << 32  # the blocks of a task are numbered on from there, in any attempt
        for batch, found in columns(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids.append(doc_id)
                held.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield close(number, ids, held)
                    ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield close(number, ids, held)

    return texts(docs).mapInArrow(run, BLOCKS)


class Block:
    def __init__(self, meta: bytes, body: bytes):
        self.ids, self.nulls, sizes = unpack(meta, "<i8").reshape(3, -1)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.raw = zstandard.ZstdDecompressor().decompress(body) if self.ends[-1] else b""
        self.data = np.frombuffer(self.raw, np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return runs(self.data, self.ends)


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist() if len(x) else []
    return list(zip(cuts, [*cuts[1:], len(x)], strict=False))


def _dealt(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards by the first 24 bits, and the 40 other bits. That few bits may take strange keys for equal, whose snippets then differ."""
    return ((hashes >> np.uint64(KEY_BITS)) % np.uint64(shards)).astype(np.int64), (hashes & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


def _cells(hashes: np.ndarray, shards: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """shard, its sorted distinct keys, how often each stands here; by shard."""
    shard, key = _dealt(hashes, shards)
    every, times = np.unique((shard << KEY_BITS) | key, return_counts=True)
    return [(int(every[a] >> KEY_BITS), every[a:b] & ((1 << KEY_BITS) - 1), times[a:b]) for a, b in _stretches(every >> KEY_BITS)]


def _keys(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, meta, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = _cells(Block(meta, body).runs()[2], shards)
                if cells:
                    made = [pack(np.r_[np.diff(keys, prepend=0), np.minimum(times, HOT)], "<i8") for _, keys, times in cells]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(cells)), pa.array([s for s, _, _ in cells], pa.int32()), pa.array(made)], ["block", "shard", "keys"])

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """Of each cell's keys: 0 stands alone, 1 repeats, 2 repeats very often."""
    cells = [unpack(k, "<i8").reshape(2, -1) for k in rows.column("keys").to_pylist()]
    keys = np.concatenate([np.cumsum(c[0]) for c in cells])
    _, number = np.unique(keys, return_inverse=True)
    total = np.bincount(number, np.concatenate([c[1] for c in cells]))[number]
    kind = (total >= 2).astype(np.uint8) + (total >= HOT)
    answers = np.split(kind, np.cumsum([c.shape[1] for c in cells])[:-1])
    return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "answer": pa.array([pack(a, "u1") for a in answers], pa.binary())})


def _snippets(shards: int, out_shards: int):
    """A block's runs whose minimizers repeat, as cells of distinct snippets and where they stand."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Block(row["meta"], row["body"])
        first, last, hashes = own.runs()
        found = dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True))
        kind = np.zeros(len(first), np.uint8)
        if found:
            every = [(s << KEY_BITS | keys, unpack(found[s], "u1")) for s, keys, _ in _cells(hashes, shards)]
            shard, key = _dealt(hashes, shards)
            kind = np.concatenate([a for _, a in every])[np.searchsorted(np.concatenate([k for k, _ in every]), shard << KEY_BITS | key)]
        hot = np.flatnonzero(kind == 2)
        counts = (last - first + 1)[hot]
        single = np.repeat(first[hot] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        group = [string_hashes(own.data, single[i : i + 20_000]) for i in range(0, len(single), 20_000)]
        a = np.r_[first[kind == 1], single]
        b = np.r_[last[kind == 1], single] + LENGTH
        group = np.concatenate([_finish(hashes[kind == 1]), *group])
        doc = np.searchsorted(own.ends, a, side="right")
        shard = (group % np.uint64(out_shards)).astype(np.int64)
        out = []
        order = np.argsort(shard, kind="stable")
        for x, y in _stretches(shard[order]):
            some, number = order[x:y], {}
            of = np.array([number.setdefault(own.raw[a[i] : b[i]], len(number)) for i in some.tolist()])
            chief = np.empty(len(number), np.int64)
            chief[of] = some
            sub = ((group[chief] >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.int64)
            places = np.concatenate([[len(number), len(some)], sub, [len(s) for s in number], of, doc[some], own.ids[doc[some]], a[some] - own.begins[doc[some]]])
            out.append((row["block"], int(shard[some[0]]), zstandard.ZstdCompressor(level=1).compress(b"".join(number)), pack(places, "<i8")))
        block, number, body, places = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"block": pa.array(block, pa.int64()), "shard": pa.array(number, pa.int32()), "body": pa.array(body, pa.binary()), "places": pa.array(places, pa.binary())})

    return run


def _search(rows: pa.Table) -> pa.Table:
    """Per cell's block: document of the block, first and last removed start, as rows of three."""
    texts_, subs, snippet, where = [], [], [], []
    for cell, (body, places) in enumerate(zip(rows.column("body").to_pylist(), rows.column("places").to_pylist(), strict=True)):
        places = unpack(places, "<i8")
        n, m = places[:2]
        sub, size = places[2 : 2 + n], places[2 + n : 2 + 2 * n]
        raw = zstandard.ZstdDecompressor().decompress(body)
        ends = np.cumsum(size).tolist()
        snippet.append(len(texts_) + places[2 + 2 * n : 2 + 2 * n + m])
        texts_ += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        subs.append(sub)
        where.append(np.r_[places[2 + 2 * n + m :].reshape(3, m), np.full((1, m), cell)])
    coded = pa.array(texts_, pa.large_binary()).dictionary_encode()
    distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sub = np.zeros(len(distinct), np.int64)
    sub[number] = np.concatenate(subs)
    of = number[np.concatenate(snippet)]
    doc, doc_id, start, cell = np.concatenate(where, axis=1)
    block = rows.column("block").to_numpy()[cell]
    order = np.lexsort((start, doc, block, doc_id, of))  # by snippet, and then as they come in the corpus
    of, doc, doc_id, start, cell, block = (x[order] for x in (of, doc, doc_id, start, cell, block))
    size = np.array([len(t) for t in distinct])
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    out = [[] for _ in range(rows.num_rows)]

    def tell(i: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        by = np.argsort(cell[i], kind="stable")
        at, triple = cell[i][by], np.stack([doc[i], a, b])[:, by]
        for x, y in _stretches(at):
            out[at[x]].append(triple[:, x:y])

    rest = np.flatnonzero(nth >= 2)  # as the second one, which the search covers
    tell(rest, start[rest], start[rest] + size[of[rest]] - LENGTH)
    chosen = np.flatnonzero(nth < 2)
    chunks = max(1, -(-int((size[of[chosen]] + 1).sum()) // CHUNK))
    part = sub[of[chosen]] * chunks >> 16
    by = np.argsort(part, kind="stable")
    for x, y in _stretches(part[by]):
        some = chosen[by[x:y]]
        _, rank = np.unique(np.stack([doc_id[some], block[some], doc[some]]), axis=1, return_inverse=True)
        gone = repeated_starts([distinct[k] for k in of[some].tolist()], rank.reshape(-1), start[some])
        counts = size[of[some]] - LENGTH + 1
        flat = np.concatenate(gone)
        entry = np.repeat(np.arange(len(some)), counts)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.flatnonzero(flat & np.r_[True, ~flat[:-1] | (entry[1:] != entry[:-1])])
        end = np.flatnonzero(flat & np.r_[~flat[1:] | (entry[1:] != entry[:-1]), True])
        who = some[entry[begin]]
        tell(who, start[who] + at[begin], start[who] + at[end])
    kept = [i for i, o in enumerate(out) if o]
    made = [pack(np.concatenate(out[i], axis=1), "<i8") for i in kept]
    return pa.table({"block": rows.column("block").take(pa.array(kept, pa.int64())), "gone": pa.array(made, pa.binary())})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(spans: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Block(row["meta"], row["body"])
        depth = np.zeros(len(own.data) + 1, np.int32)
        for gone in right.column("gone").to_pylist():
            doc, a, b = unpack(gone, "<i8").reshape(3, -1)
            np.add.at(depth, own.begins[doc] + a, 1)
            np.add.at(depth, own.begins[doc] + b + LENGTH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        out = []
        for begin, end in zip(own.begins.tolist(), own.ends.tolist(), strict=True):
            mask = gone[begin:end]
            edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
            kept = own.raw[begin:end] if not len(edges) else own.data[begin:end][~mask].tobytes()
            found = (end - begin, int(mask.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
            out.append(found + (([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()],) if spans else ()))
        n_bytes, n_removed, n_spans, sha, *runs_ = zip(*out, strict=True)
        made = {
            "doc_id": pa.array(own.ids, mask=own.nulls.astype(bool)), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha),
        }
        if spans:
            made["spans"] = pa.array(runs_[0], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(made)

    return run


def repeated_passages(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs, and with spans the removed byte ranges.

    A null text counts as empty. Texts come in the order of doc_id; a null doc_id comes last, and rows of
    one doc_id in the order of partitions and of rows in these, so that of repeated rows one stays, and the same one in each run.
    Texts of less than LENGTH bytes stay whole. An empty table gives an empty result. Other columns of docs are ignored.
    """
    parts, scans = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), scan_parts(docs)
    shards, out_shards = min(1 << 23, max(parts, 2 * scans)), max(parts, 4 * scans)
    made = table(blocks(docs), "passage-blocks")
    keys = made.select("block", "meta", "body").mapInArrow(_keys(shards), "block long, shard int, keys binary")
    answers = keys.groupBy("shard").applyInArrow(_answer, "block long, shard int, answer binary")
    cells = made.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_snippets(shards, out_shards), "block long, shard int, body binary, places binary")
    gone = cells.groupBy("shard").applyInArrow(_search, "block long, gone binary")
    kinds = RESULT + (", spans array<struct<start:long,end:long>>" if spans else "")
    return made.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_cut(spans), kinds)
