"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every token has a sparse random index vector (a few +1 and -1, drawn from its row). A word's vector is
the sum of its neighbours' index vectors over the whole corpus. The words that most labelled texts have get a row
each; other words share hashed rows, as do the shapes of tokens. A document is the mean of its tokens' normalised
vectors. Texts are split once: their rows are written, and counted and pooled from there. The network's logit is divided
by a temperature that is fitted on rows that its weights never saw.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import few_tasks, slices, table, texts

#: Labelled rows to fit on, those of least hashed doc_id: a bounded sample.
MAX_LABELLED = 20_000
#: Words with a row of their own, in FEW labelled texts or more; hashed rows for other words and for shapes.
OWN, FEW, OTHERS, SHAPES = 1 << 14, 2, 1 << 12, 1 << 12
#: Rows and width of the vectors, non-zeros of an index vector, neighbours on either side.
ROWS, WIDTH, NONZERO, WINDOW = OWN + OTHERS + SHAPES, 32, 4, 2
#: Rows of tokens that are counted at once.
STRETCH = 1 << 20
HIDDEN, EPOCHS, BATCH, RATE, PENALTY = 32, 40, 128, 3e-3, 1e-4
#: Of the labelled rows, one in so many fits the temperature only.
CALIBRATE = 5
#: Share of held-out doc_ids: crc32 of the doc_id's decimal text, modulo FOLDS, is 0.
FOLDS = 5
THRESHOLD = 0.3
MEMO = 200_000

#: What str.split() cuts at, as Java puts it.
BLANKS = r"(?U)[\s\x1c-\x1f]+"

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def shape(token: str) -> str:
    """Letters become their case, digits 0; what else there is stays."""
    cased = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a" if m[0].islower() or not m[0][0].isupper() else "Aa", token)
    return _DIGITS.sub("0", cased)


class Tokens(dict):
    """Of a token, word row + ROWS x shape row. own: the words with a row of their own, in the order of these."""

    def __init__(self, own: list[str]):
        self.own = {w: i for i, w in enumerate(own)}

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        word = self.own.get(token)
        if word is None:
            word = OWN + xxhash.xxh32_intdigest(token) % OTHERS
        code = self[token] = word + ROWS * (OWN + OTHERS + xxhash.xxh32_intdigest(shape(token), 1) % SHAPES)
        return code


REPEAT = OWN + OTHERS + xxhash.xxh32_intdigest("repeat", 2) % SHAPES


def rows_of(text: str, memo: Tokens) -> np.ndarray:
    """The text's rows in order: each token's word and shape; an immediate repetition has a shape of its own."""
    found = text.split()
    codes = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
    out = np.empty(2 * len(codes), np.uint16)
    out[::2], out[1::2] = codes % ROWS, codes // ROWS
    out[3::2][codes[1:] == codes[:-1]] = REPEAT
    return out


def own_words(texts_: DataFrame) -> list[str]:
    """The up to OWN words that most of the texts have, by their number and then by the word."""
    found = texts_.select(F.explode(F.array_distinct(F.split("text", BLANKS))).alias("word")).where("word <> ''")
    counted = found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEW)
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(OWN).collect()]


def coded_texts(docs: DataFrame, own: list[str], *more: str) -> DataFrame:
    """doc_id, codes (rows_of as bytes), `more` columns."""
    rows, sent = texts(docs, *more), docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens(sent.value)
        for batch in slices(batches):
            made = pa.array([rows_of(t, memo).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made, *(batch.column(n) for n in more)], ["doc_id", "codes", *more])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in more)
    return rows.mapInArrow(run, f"doc_id long, codes binary{kinds}")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (ROWS, NONZERO) and signs of each row's index vector."""
    rng = np.random.default_rng(42)
    places = np.argsort(rng.random((ROWS, WIDTH)), axis=1)[:, :NONZERO]
    return places, np.tile([1.0, -1.0], (ROWS, NONZERO // 2))


def _count(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds the index vectors of each row's neighbours; -1 parts texts."""
    for far in range(1, WINDOW + 1):
        a, b = ids[:-far], ids[far:]
        both = (a >= 0) & (b >= 0)
        if far > 1:
            both &= ids[1:-1] >= 0
        a, b = a[both], b[both]
        for j in range(NONZERO):
            total += np.bincount(a * WIDTH + places[b, j], signs[b, j], ROWS * WIDTH)
            total += np.bincount(b * WIDTH + places[a, j], signs[a, j], ROWS * WIDTH)


def word_vectors(coded: DataFrame) -> np.ndarray:
    """(ROWS, WIDTH) context vectors over all texts, of unit length after their mean is taken off.

    Each task adds up what it reads; Spark sums the tasks' rows. The result's size is fixed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(ROWS * WIDTH), [], 0
        places, signs = index_vectors()
        gap = np.full(1, -1)
        for batch in batches:
            for codes in batch.column("codes").to_pylist():
                ids = np.frombuffer(codes, np.uint16)
                for at in range(0, len(ids), STRETCH):  # a stretch begins with the last WINDOW rows of the one before
                    held += [ids[max(0, at - WINDOW) : at + STRETCH].astype(np.int64), gap]
                    if at:  # pairs among those are counted before
                        first = held[-2][:WINDOW]
                        _count(total, first, places, -signs)
                    size += len(held[-2])
                    if size >= STRETCH:
                        _count(total, np.concatenate(held), places, signs)
                        held, size = [], 0
        if held:
            _count(total, np.concatenate(held), places, signs)
        grid = total.astype(np.int64).reshape(ROWS, WIDTH)
        used = np.flatnonzero(grid.any(axis=1))
        for at in range(0, len(used), 1024):
            some = used[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(grid[some, k]) for k in range(WIDTH))], ["row", *(f"v{k}" for k in range(WIDTH))])

    kinds = ", ".join(f"v{k} long" for k in range(WIDTH))
    summed = few_tasks(coded.select("codes")).mapInArrow(run, f"row long, {kinds}").groupBy("row").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH)))
    got = summed.toArrow()  # at most ROWS rows
    out, at = np.zeros((ROWS, WIDTH)), got.column("row").to_numpy()
    for k in range(WIDTH):
        out[at, k] = got.column(f"v{k}").to_numpy()
    length = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.maximum(length, 1)
    if len(at):
        out[at] -= out[np.sort(at)].mean(axis=0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means of the vectors of the words and of the shapes; zeros where there are none."""
    if not len(ids):
        return np.zeros(2 * WIDTH, np.float32)
    out = []
    for own in (ids[::2], ids[1::2]):
        used, times = np.unique(own, return_counts=True)
        out.append(times @ vectors[used] / len(own))
    return np.concatenate(out).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam over mini-batches; then the temperature of least log loss on the calibration rows.

    Without rows, or with one label only, the score is that label's smoothed share everywhere.
    """
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, own = (order[: len(y) // CALIBRATE], order[len(y) // CALIBRATE :])
    net = Network(x[own].mean(0), x[own].std(0) + 1e-6, rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), flat.b2)
    z, t = (x[own] - net.mean) / net.scale, y[own].astype(float)
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(t)), max(1, len(t) // BATCH)):
            step += 1
            hidden = np.maximum(z[some] @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - t[some]) / len(some)
            back = error[:, None] * p[2] * (hidden > 0)
            grads = [z[some].T @ back + PENALTY * p[0], back.sum(0), hidden.T @ error + PENALTY * p[2], np.array([error.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(aside):
        logit, target = net.logit(x[aside]), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(target == 1, -1, 1) * logit / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def pooled(coded: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x (pooled vector as float32 bytes)."""
    sent = coded.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([pool(np.frombuffer(c, np.uint16), sent.value).tobytes() for c in batch.column("codes").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], ["doc_id", "x"])

    return coded.select("doc_id", "codes").mapInArrow(run, "doc_id long, x binary")


def quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    Labels are learnt from rows that aren't held out only; lang, source and doc_id are no inputs. Of labels that clash
    the larger one counts. A null text counts as empty and is scored by its zero vector. A null doc_id is never labelled
    and not held out. Rows come back one for one, repeated rows too. Texts of any length are taken whole. Without labels
    every score is 0.5. An empty table gives an empty result; other columns are ignored. The driver gets `bound` rows at most to
    fit on, one a doc_id: of repeated ones that of the least pooled vector.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    known = known.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % FOLDS != 0)
    known = F.broadcast(table(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "quality-labels"))  # at most `bound` rows
    labelled = texts(docs).join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    coded = table(coded_texts(docs, own_words(labelled)), "quality-codes")
    rows = table(pooled(coded, word_vectors(coded)), "pooled")
    sample = rows.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, 2 * WIDTH).astype(float)
    net = train(x, sample["quality"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, 2 * WIDTH).astype(float)
            p = net.probability(x)
            fold = [d is not None and held_out(d) for d in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fold, pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
