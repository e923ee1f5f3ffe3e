"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

The alphabet of the automaton is the items' words, numbered; a word of a document that no item has is 0
and breaks every match. The patterns are the items' PIECES, which keeps the automaton at about a node a word: every
window of WINDOW consecutive words of an item holds one of the pieces of half a window that begin at whole multiples of
their length. Where a piece ends in a text, its surroundings in the items tell which windows are there. An item of fewer
words than a window is a pattern itself. Words keep their places, so hits map back to byte offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import columns, texts

#: Words of a window.
WINDOW = 10
#: Every worker makes the automaton (12 bytes held, 25 at the peak for each byte of the items); larger benchmarks are refused.
MAX_BENCHMARK_BYTES = 32 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEEP = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))

SPANS = "array<struct<start:long,end:long>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, item_ids array<string>, spans {SPANS}"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and bytes from 0x80."""
    return text.translate(_KEEP).split()


class Automaton:
    """Pieces over numbered words; for each, the distinct surroundings in which items have it.

    A pattern's number leads to rows of `around`, the reach words before and after it (-1 beyond an item's ends), and
    to the items of each row; a row of a whole short item has no surroundings to compare.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.window, self.piece = window, (window + 1) // 2
        self.reach = window - self.piece
        self.names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        pieces, whole = [], []
        for item, text in items:
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.int32)
            if len(own) >= window:
                starts = np.arange(0, len(own) - self.piece + 1, self.piece)
                padded = np.pad(own, self.reach, constant_values=-1)
                rows = np.lib.stride_tricks.sliding_window_view(padded, self.piece + 2 * self.reach)[starts]
                pieces.append(np.c_[rows[:, self.reach : self.reach + self.piece], rows[:, : self.reach], rows[:, self.reach + self.piece :], np.full(len(rows), number[item], np.int32)])
            elif len(own):
                whole.append((tuple(own.tolist()), number[item]))
        self.tree = None
        if not pieces and not whole:
            return
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        rows = np.unique(np.concatenate(pieces), axis=0) if pieces else np.zeros((0, window + self.reach + 1), np.int32)
        new = np.r_[True, (rows[1:, : -1] != rows[:-1, : -1]).any(axis=1)][: len(rows)]
        self.around = rows[new][:, self.piece : -1].copy()
        self.item_at, self.item_of = np.r_[np.flatnonzero(new), len(rows)], rows[:, -1].copy()
        heads = rows[new][:, : self.piece]
        first = np.flatnonzero(np.r_[True, (heads[1:] != heads[:-1]).any(axis=1)][: len(heads)])
        self.row_at = np.r_[first, len(heads)]
        for i, head in enumerate(heads[first].tolist()):
            self.tree.add_word(tuple(head), i)
        #: Of patterns that are whole short items: their length and items.
        self.short: dict[int, tuple[int, list[int]]] = {}
        known = len(first)
        for own, item in whole:
            i = self.tree.get(own, None)
            if i is None:
                i, known = known, known + 1
                self.tree.add_word(own, i)
            self.short.setdefault(i, (len(own), []))[1].append(item)
        self.tree.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Words of the text, the mask of those hit (None: none), items with occurring windows."""
        found, items, mask, padded = words(text), set(), None, None
        if self.tree is None or not found:
            return len(found), None, items
        get = self.ids.get
        numbered = tuple([get(w, 0) for w in found])
        for end, i in self.tree.iter(numbered):
            spans = []
            if i in self.short:
                length, own = self.short[i]
                spans.append((end + 1 - length, end + 1))
                items.update(own)
            if i < len(self.row_at) - 1:
                if padded is None:
                    padded = np.pad(np.array(numbered, np.int32), self.reach, constant_values=-2)
                a, b = self.row_at[i], self.row_at[i + 1]
                start = end + 1 - self.piece
                like = self.around[a:b] == np.r_[padded[start : start + self.reach], padded[end + 1 + self.reach : end + 1 + 2 * self.reach]]
                before = np.cumprod(like[:, : self.reach][:, ::-1], axis=1).sum(axis=1)
                after = np.cumprod(like[:, self.reach :], axis=1).sum(axis=1)
                for row in np.flatnonzero(before + after >= self.reach).tolist():
                    spans.append((start - before[row], end + 1 + after[row]))
                    items.update(self.item_of[self.item_at[a + row] : self.item_at[a + row + 1]].tolist())
            if spans and mask is None:
                mask = np.zeros(len(found), bool)
            for x, y in spans:
                mask[x:y] = True
        return len(found), mask, {self.names[i] for i in items}


_automata: dict[str, Automaton] = {}


def _shared(items: list[tuple[str, bytes]], window: int, docs: DataFrame):
    """A function that gives a Python worker its automaton, made once from the broadcast items."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def get() -> Automaton:
        if name not in _automata:
            _automata.clear()
            _automata[name] = Automaton(sent.value, window)
        return _automata[name]

    return get


def _spans(text: bytes, mask: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as byte offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def test_items(benchmark: DataFrame) -> list[tuple[str, bytes]]:
    """item_id and text of all items, once their texts' size is checked."""
    kept = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; at most {MAX_BENCHMARK_BYTES} go into one automaton")
    return [(r.item, bytes(r.text)) for r in kept.collect()]


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no window occurs.

    Null texts have no words and stay; repeated rows stay or go together; an empty benchmark lets all rows stay.
    """
    automaton = _shared(test_items(benchmark), window, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        for batch, found in columns(batches):
            yield batch.filter(pa.array([tree.scan(t or b"")[1] is None for t in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), spans (bytes of the original text) per row of docs.

    Null texts of either table have no words; items without words match nothing. Repeated items count
    once by item_id; an item with a null item_id is named "null". Repeated rows of docs come back as
    often as they are given. Empty tables give empty results (docs) or no hits (benchmark).
    """
    automaton = _shared(test_items(benchmark), window, docs)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        for batch, found in columns(batches):
            rows = []
            for text in found:
                n, mask, at = tree.scan(text)
                rows.append((n, 0, [], []) if mask is None else (n, int(mask.sum()), sorted(at), _spans(text, mask)))
            n_words, n_hit, ids, runs = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(runs, spans)],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)
