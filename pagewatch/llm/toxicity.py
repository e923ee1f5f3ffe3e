"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector for all thresholds t_0 <= t_1 <= t_2; the expected
severity is the sum of these probabilities. Features are words and word beginnings (inflected insults
share their beginning), as logs of their counts; those that always come together share one weight. labels has 0 and 1
only, so the grades 1 to GRADES - 1 of its toxic rows are quantiles of how surely a simple model of the sample's other
half, which never saw the row, tells it from clean rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import slices, table, texts

#: Labelled rows to fit on, those of least hashed doc_id: a bounded sample.
MAX_LABELLED = 12_000
GRADES = 4
#: Letters of the beginnings of words that are features beside whole words.
PREFIXES = (4, 5, 6)
#: A feature counts if so many toxic rows have it, and it is so many times as frequent in toxic rows.
MIN_TOXIC, MIN_RATIO = 4, 8.0
#: A document is rejected where it is likelier than not to have a grade over 0.
THRESHOLD = 0.5
#: Words whose features a worker remembers.
MEMO = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_NOTHING = np.zeros(0, np.uint32)


def word_features(word: str) -> list[int]:
    """32-bit hashes: of the word, and of its beginnings."""
    return [xxhash.xxh32_intdigest(word)] + [xxhash.xxh32_intdigest(word[:n], n) for n in PREFIXES if len(word) >= n]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Ordinal:
    """features: sorted hashes; weights: of each; cuts: ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of a grade over each k, from the sums w.x."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - x[:, None], -40, 40)))

    def severity(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).sum(axis=1)


@dataclass
class Sparse:
    """Rows of a matrix: `at` cuts columns and values into rows."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Sparse:
        at = np.r_[0, np.cumsum([len(c) for c, _ in rows])].astype(np.int64)
        columns, values = (np.concatenate([np.asarray(r[k]) for r in rows]) if rows else np.zeros(0) for k in (0, 1))
        return cls(at, columns.astype(np.int64), values.astype(float), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(self.values * w[self.columns])]
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * np.repeat(g, np.diff(self.at)), self.width)


def fit_ordinal(x: Sparse, y: np.ndarray, times: np.ndarray, grades: int = GRADES, penalty: float = 3e-5, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of least mean log loss (Adam); times: how often each row stands.

    Cuts are a start and positive gaps, hence in order.
    """
    n, width = len(y), x.width
    share = times / times.sum()
    rows, has, more = np.arange(n), np.flatnonzero(y > 0), np.flatnonzero(y < grades - 1)
    p = np.zeros(width + grades - 1)
    p[width] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        cuts = p[width] + np.r_[0, np.cumsum(gaps)]
        over = 1 / (1 + np.exp(np.clip(cuts[None, :] - x.times(w)[:, None], -40, 40)))
        slope = over * (1 - over)
        # the mass of grade y is P(grade > y - 1) - P(grade > y)
        mass = np.maximum(np.c_[np.ones(n), over][rows, y] - np.c_[over, np.zeros(n)][rows, y], 1e-9)
        upper, lower = np.c_[np.zeros(n), slope][rows, y] * share / mass, np.c_[slope, np.zeros(n)][rows, y] * share / mass
        cut = np.zeros(grades - 1)
        np.add.at(cut, y[has] - 1, upper[has])
        np.add.at(cut, y[more], -lower[more])
        grad = np.r_[x.transposed_times(lower - upper) + penalty * w, cut.sum(), np.cumsum(cut[::-1])[::-1][1:] * gaps]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], p[width] + np.r_[0, np.cumsum(np.exp(p[width + 1 :]))]


Row = tuple[np.ndarray, np.ndarray]


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[list[Row], np.ndarray]:
    """Features (hashes, counts) of the labelled sample's distinct texts, and their labels, in an order that only these set.

    Of several texts with one doc_id the least counts; a text or doc_id with both labels is toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts = [], []
            for text in batch.column("text").to_pylist():
                ids, times = np.unique(np.array([f for w in words(text) for f in word_features(w)], np.uint32), return_counts=True)
                hashes.append(ids.tobytes())
                counts.append(np.minimum(times, 65_535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["toxic", "hashes", "counts"])

    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    one = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most `bound` rows
    sample = one.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = table(texts(sample, "toxic").mapInArrow(run, "toxic int, hashes binary, counts binary"), "toxic-labelled").toLocalIterator()
    found = sorted((bytes(r.hashes), bytes(r.counts), r.toxic) for r in rows)
    return [(np.frombuffer(h, np.uint32), np.frombuffer(c, np.uint16)) for h, c, _ in found], np.array([t for *_, t in found], int)


def _frequencies(rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([h for h, _ in rows] or [_NOTHING]), return_counts=True)


def _telling(rows: list[Row], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that tell toxic rows from others, sorted, and the logs of how many times as frequent they are there."""
    (bad, bad_n), (good, good_n) = (_frequencies([r for r, t in zip(rows, toxic, strict=True) if t == k]) for k in (1, 0))
    at = np.minimum(np.searchsorted(good, bad), max(len(good) - 1, 0))
    other = np.where(good[at] == bad, good_n[at], 0) if len(good) else np.zeros(len(bad))
    ratio = (bad_n / max(toxic.sum(), 1)) / ((other + 0.5) / max((1 - toxic).sum(), 1))
    kept = (bad_n >= MIN_TOXIC) & (ratio >= MIN_RATIO)
    return bad[kept], np.log(ratio[kept])


def _on(rows: list[Row], features: np.ndarray) -> Sparse:
    """The rows' logs of counts of the features."""
    made = []
    for h, c in rows:
        at = np.searchsorted(features, h)
        own = np.flatnonzero(features[np.minimum(at, len(features) - 1)] == h) if len(features) else _NOTHING.astype(int)
        made.append((at[own], np.log1p(c[own])))
    return Sparse.of(made, len(features))


def grades_of(rows: list[Row], toxic: np.ndarray) -> np.ndarray:
    """0 of clean rows; of toxic rows 1 to GRADES - 1, quantiles of their log odds by the model of the half that they aren't in."""
    half, much = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for own in (0, 1):
        features, odds = _telling([r for r, h in zip(rows, half, strict=True) if h != own], toxic[half != own])
        if len(features):
            much[half == own] = _on([r for r, h in zip(rows, half, strict=True) if h == own], features).times(odds)
    edges = np.quantile(much[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic == 1, 1 + np.searchsorted(edges, much, side="right"), 0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Ordinal:
    """The model of at most `bound` labelled documents.

    Without toxic and other rows among the labelled ones, or features that tell them apart, the model gives every text severity 0.
    Labels without a doc_id or with another value than 0 and 1 don't count; null texts count as empty; repeated texts count once.
    Neither the order of rows nor other columns matter.
    """
    rows, toxic = _labelled(docs, labels, bound)
    nothing = Ordinal(_NOTHING, np.zeros(0), np.full(GRADES - 1, 40.0))
    if not toxic.any() or toxic.all():
        return nothing
    features, _ = _telling(rows, toxic)
    if not len(features):
        return nothing
    grade, x = grades_of(rows, toxic), _on(rows, features)
    some = np.diff(x.at) > 0
    none = np.bincount(grade[~some], minlength=GRADES)  # rows without features differ by grade only
    # columns that are the same in all rows share a weight
    order = np.lexsort((np.repeat(np.arange(len(rows)), np.diff(x.at)), x.columns))
    owner = np.repeat(np.arange(len(rows)), np.diff(x.at))[order]
    ends = np.cumsum(np.bincount(x.columns, minlength=len(features)))
    bodies = [owner[a:b].tobytes() + x.values[order][a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    number: dict[bytes, int] = {}
    group = np.array([number.setdefault(b, len(number)) for b in bodies])
    first, size = np.unique(group, return_index=True)[1], np.bincount(group)
    chief = np.full(len(features), -1)
    chief[first] = group[first]
    made = []
    for a, b, own in zip(x.at[:-1], x.at[1:], some, strict=True):
        if own:
            columns = chief[x.columns[a:b]]
            made.append((columns[columns >= 0], x.values[a:b][columns >= 0]))
    made += [(np.zeros(0, int), np.zeros(0))] * GRADES
    weights, cuts = fit_ordinal(Sparse.of(made, len(number)), np.r_[grade[some], np.arange(GRADES)], np.r_[np.ones(some.sum()), none])
    return Ordinal(features, (weights / size)[group], cuts)


class _Memo(dict):
    """Of a word, the places of its features among the model's."""

    def __init__(self, features: np.ndarray):
        self.place = {int(f): i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = tuple(i for f in word_features(word) if (i := self.place.get(f)) is not None)
        return found


def _sums(found: list[str | None], model: Ordinal, memo: _Memo) -> np.ndarray:
    """w.x of each text."""
    x = np.zeros(len(found))
    for i, text in enumerate(found):
        times: dict[int, int] = {}
        for at in filter(None, [memo[w] for w in words(text or "")]):
            for f in at:
                times[f] = times.get(f, 0) + 1
        if times:
            x[i] = np.log1p(list(times.values())) @ model.weights[list(times)]
    return x


def keep_clean(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text isn't toxic. Null texts count as empty; repeated rows stay or go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model.features)
        for batch in slices(batches):
            found = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(model.probabilities(_sums(found, model, memo))[:, 0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (0 to GRADES - 1), p_toxic (of a grade over 0), toxic.

    A null text counts as empty: no features, the severity of the intercepts. Rows come back one for one,
    repeated rows too; a null doc_id stays null. The whole text is read. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model.features)
        for batch in slices(batches):
            over = model.probabilities(_sums(batch.column("text").to_pylist(), model, memo))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(over[:, 0] >= THRESHOLD)], ["doc_id", "severity", "p_toxic", "toxic"])

    return texts(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")
