"""Log-probabilities of texts by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The words that the training texts have most often are classes of their own; all other words share one, within which a
word's probability follows its count, with one count more and one word more for what was never seen. The model predicts the
class from the embeddings of the classes before it. Texts are read in blocks: the counts of a block's words come back to
it (see dealing), and from there on a text is a sequence of class numbers. Every training token is trained on once: in
each round a part of the blocks, every task from the same parameters, whose mean by tokens begins the next round. Scores
are normalised over all classes by matrix products over the distinct contexts of a block.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.dealing import ASKED, ASKED_ARROW, CELLS, answered, coded, dealt, pack, unpack, unpack_keys, values_of
from pagewatch.llm.shared import columns, few_tasks, table, texts
from pagewatch.llm.vectors import STRIPS, strips, summed

#: Words that are classes of their own, classes before a token that predict it, and the width of embeddings.
TOP, CONTEXT, WIDTH = 512, 3, 16
#: Noise words of a batch, tokens of a batch, rounds, and step size.
NOISE, BATCH, ROUNDS, RATE = 32, 1024, 4, 0.08
#: Share of held-out doc_ids: crc32 of the doc_id's decimal text, modulo FOLDS, is FOLD.
FOLDS, FOLD = 7, 2
#: Bytes of a block's texts before it is closed; contexts that are multiplied at once.
BLOCK, AT_ONCE = 6 << 20, 512

BLOCKS = f"block long, doc_ids binary, nulls binary, held binary, n_tokens binary, codes binary, asked {ASKED}"
CODED = "block long, doc_ids binary, nulls binary, held binary, n_tokens binary, n_known binary, base binary, rest binary, classes binary"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == FOLD


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case, and the end: an empty word."""
    return [*raw.lower().split(), b""]


def _block(doc_ids: list, found: list[bytes]) -> dict:
    split = [tokens(t) for t in found]
    n_tokens = np.array([len(t) for t in split], np.int64)
    held = np.array([held_out(d) for d in doc_ids])
    codes, distinct = coded([t for one in split for t in one])
    counts = np.bincount(codes[~np.repeat(held, n_tokens)], minlength=len(distinct))
    rank, asked = dealt(distinct, counts, CELLS)
    return {
        "block": uuid.uuid4().int >> 65, "doc_ids": pack(np.array([d or 0 for d in doc_ids]), "<i8"), "nulls": pack(np.array([d is None for d in doc_ids]), "u1"),
        "held": pack(held, "u1"), "n_tokens": pack(n_tokens, "<i8"), "codes": pack(rank[codes], "<u4"), "asked": asked,
    }


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of BLOCKS: texts in blocks of about `size` bytes, as numbers of the block's own words."""
    schema = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "nulls", "held", "n_tokens", "codes")), ("asked", ASKED_ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, now = [], [], 0
        for batch, raws in columns(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws, strict=True):
                ids.append(doc_id)
                found.append(raw)
                now += len(raw)
                if now >= size:
                    yield pa.RecordBatch.from_pylist([_block(ids, found)], schema)
                    ids, found, now = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, found)], schema)

    return texts(docs).mapInArrow(run, BLOCKS)


@dataclass
class Vocabulary:
    """Words with a class of their own, by falling count and then by bytes; training tokens and distinct words."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    distinct: int

    @property
    def base_mass(self) -> int:
        """What the counts, one more each, add up to, with one word more for those never seen."""
        return self.n + self.distinct + 1

    @property
    def rest_mass(self) -> int:
        return self.base_mass - int(self.counts.sum()) - len(self.words)

    @property
    def classes(self) -> int:
        return len(self.words) + 1

    def noise(self) -> np.ndarray:
        """Shares of the classes in the training tokens, smoothed as the base is; the last class is all other words."""
        return np.append(self.counts + 1.0, self.rest_mass) / self.base_mass


def _total(top: int):
    """Answers each word with its count; a shard's summary has its words with most counts, in case they are so over all."""

    def answer(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, bytes]:
        known = np.flatnonzero(counts)
        first = sorted(known.tolist(), key=lambda i: (-counts[i], words[i]))[:top]
        said = {"n": int(counts.sum()), "distinct": len(known), "words": [words[i].hex() for i in first], "counts": [int(counts[i]) for i in first]}
        return counts, json.dumps(said).encode()

    return answer


def vocabulary(answers: DataFrame, top: int) -> Vocabulary:
    """From the shards' summaries. The driver gets `top` words and their counts."""
    said = F.from_json(F.col("values").cast("string"), "n long, distinct long, words array<string>, counts array<long>")
    found = answers.where("block is null").select(said.alias("s")).select("s.*")
    whole = found.agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).first()
    first = found.select(F.inline(F.arrays_zip("words", "counts"))).orderBy(F.desc("counts"), "words").limit(top).collect()
    return Vocabulary([bytes.fromhex(r.words) for r in first], np.array([r.counts for r in first], np.int64), whole.n or 0, whole.distinct or 0)


def _coded(sent):
    """A block's texts as class numbers, with what doesn't need the model summed by text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v: Vocabulary = sent.value
        row = left.to_pylist()[0]
        counts = values_of(right)
        keys = [k for cell in row["asked"] for k in unpack_keys(cell["keys"])]
        place = {w: i for i, w in enumerate(v.words)}
        least = int(v.counts.min()) if len(v.words) else 1
        classes = np.full(len(keys), len(v.words), np.uint16)
        for i in np.flatnonzero(counts >= least).tolist():
            classes[i] = place.get(keys[i], len(v.words))
        codes, n_tokens = unpack(row["codes"], "<u4"), unpack(row["n_tokens"], "<i8")
        starts = np.cumsum(n_tokens) - n_tokens  # each text has its end at least
        base = np.log10((counts + 1) / v.base_mass)
        rest = np.where(classes == len(v.words), np.log10((counts + 1) / max(v.rest_mass, 1)), 0.0)
        by_text = lambda values: np.add.reduceat(values[codes], starts)
        made = {
            "n_known": pack(by_text((counts > 0).astype(np.int64)), "<i8"), "base": by_text(base).astype("<f8").tobytes(), "rest": by_text(rest).astype("<f8").tobytes(),
            "classes": pack(classes[codes], "<u2"),
        }
        names = [f.split()[0] for f in CODED.split(", ")]
        return pa.table({n: pa.array([(row | made)[n]], pa.int64() if n == "block" else pa.binary()) for n in names})

    return run


def contexts(classes: np.ndarray, n_tokens: np.ndarray, start: int, context: int) -> np.ndarray:
    """(tokens, context): the classes before each token, nearest first; `start` before a text's first."""
    at = np.arange(len(classes)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
    out = np.full((len(classes), context), start, np.int64)
    for j in range(context):
        there = at > j
        out[there, j] = classes[np.flatnonzero(there) - j - 1]
    return out


class Model:
    """Class embeddings before (r) and after (q) a position, a matrix for each place of the context (c), biases (b)."""

    def __init__(self, noise: np.ndarray, context: int = CONTEXT, width: int = WIDTH, seed: int = 3):
        rng, n = np.random.default_rng(seed), len(noise)
        self.noise, self.context, self.width = noise, context, width
        shapes = {"r": (n + 1, width), "q": (n, width), "c": (context, width, width), "b": (n,)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.flat, self.squares = np.zeros(ends[-1], np.float32), np.full(ends[-1], 1e-2, np.float32)
        self._parts = {name: (a, b, shape) for (name, shape), a, b in zip(shapes.items(), [0, *ends], ends, strict=False)}
        self.part("r")[:] = rng.normal(0, 0.1, shapes["r"])
        self.part("c")[:] = np.eye(width) / context
        self.part("b")[:] = np.log(noise)  # without embeddings the model is the base

    def part(self, name: str, of: np.ndarray | None = None) -> np.ndarray:
        a, b, shape = self._parts[name]
        return (self.flat if of is None else of)[a:b].reshape(shape)

    def state(self) -> np.ndarray:
        return np.concatenate([self.flat, self.squares]).astype(float)

    def load(self, state: np.ndarray) -> None:
        self.flat, self.squares = np.split(state.astype(np.float32), 2)

    def hidden(self, before: np.ndarray) -> np.ndarray:
        r, c = self.part("r"), self.part("c")
        return sum(r[before[:, j]] @ c[j] for j in range(self.context))

    def train(self, before: np.ndarray, after: np.ndarray, seed: int) -> None:
        """One pass over the tokens in random order: words of a batch against NOISE words drawn for it, by Adagrad."""
        rng, ends = np.random.default_rng(seed), np.cumsum(self.noise)
        log_noise = (np.log(self.noise) + np.log(NOISE)).astype(np.float32)
        order = rng.permutation(len(after))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            drawn = np.minimum(np.searchsorted(ends, rng.random(NOISE)), len(ends) - 1)
            self._step(before[some], after[some], drawn, log_noise)

    def _step(self, before: np.ndarray, after: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray) -> None:
        r, q, c, b = (self.part(n) for n in "rqcb")
        grad = np.zeros_like(self.flat)
        vectors = [r[before[:, j]] for j in range(self.context)]
        h = sum(x @ c[j] for j, x in enumerate(vectors))
        own, others = q[after], q[drawn]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, own) + b[after] - log_noise[after]))
        down = -1 / (1 + np.exp(-(h @ others.T + (b[drawn] - log_noise[drawn]))))
        back = up[:, None] * own + down @ others
        width, gq, gr, gb, gc = self.width, self.part("q", grad), self.part("r", grad), self.part("b", grad), self.part("c", grad)
        spread = lambda ids, rows, n: np.bincount((ids[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width)
        gq += spread(np.concatenate([after, drawn]), np.concatenate([up[:, None] * h, down.T @ h]), len(q))
        gb += np.bincount(after, up, len(b)) + np.bincount(drawn, down.sum(0), len(b))
        gr += spread(before.T.ravel(), np.concatenate([back @ c[j].T for j in range(self.context)]), len(r))
        for j, x in enumerate(vectors):
            gc[j] = x.T @ back
        grad /= len(after)
        self.squares += grad * grad
        self.flat += RATE * grad / np.sqrt(self.squares)

    def log_probabilities(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Natural logarithms of each token's class, normalised over all classes; each distinct context is multiplied once."""
        q, b = self.part("q"), self.part("b")
        key = before @ (len(q) + 1) ** np.arange(self.context)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        h, norm = self.hidden(before[first]), np.empty(len(first), np.float32)
        for at in range(0, len(first), AT_ONCE):
            logits = h[at : at + AT_ONCE] @ q.T + b
            top = logits.max(axis=1)
            np.exp(logits - top[:, None], out=logits)
            norm[at : at + AT_ONCE] = np.log(logits.sum(axis=1)) + top
        out = np.empty(len(after))
        for at in range(0, len(after), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = np.einsum("ij,ij->i", h[which[part]], q[after[part]]) + b[after[part]] - norm[which[part]]
        return out


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(batch.num_rows):  # a block at a time
            row = batch.slice(at, 1).to_pylist()[0]
            yield row, unpack(row["classes"], "<u2").astype(np.int64), unpack(row["n_tokens"], "<i8")


def fit(sequences: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Trained on every training token once, a part of the blocks in each round. The driver gets one model a round."""
    model = Model(v.noise())
    size = 2 * len(model.flat)
    for round_ in range(rounds):
        sent = sequences.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Model(sent.value.noise)
            own.load(sent.value.state())
            seen = 0
            for row, classes, n_tokens in _sequences(batches):
                train = np.repeat(unpack(row["held"], "u1") == 0, n_tokens)
                before = contexts(classes, n_tokens, v.classes, own.context)[train]
                own.train(before, classes[train], row["block"] % (1 << 32))
                seen += len(before)
            if seen:
                yield strips(np.append(own.state() * seen, seen))

        some = sequences.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == round_).select("block", "held", "n_tokens", "classes")
        *state, seen = summed(few_tasks(some).mapInArrow(run, STRIPS), (size + 1,))
        sent.unpersist()
        if seen:
            model.load(np.array(state) / seen)
    return model


def score(docs: DataFrame, top: int = TOP, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs.

    Tokens are the text's words (runs of what isn't ASCII blank, A-Z in lower case) and an end. A null text counts as empty: its
    only token is the end. A null doc_id isn't held out, and comes back. Rows come back one for one, repeated rows too, and count
    each. base_score: log10 of the product of (count + 1) / (tokens + distinct words + 1) over training tokens; score: the
    model's log10 probability of the whole text. Without training texts both take every word as new. Texts of any length are
    taken whole: a block closes after the text that fills it. An empty table gives an empty result; other columns are ignored.
    """
    made = table(blocks(docs), "word-blocks")
    answers = table(answered(made, _total(top)), "word-counts")
    v = vocabulary(answers, top)
    sent = docs.sparkSession.sparkContext.broadcast(v)  # `top` words
    sequences = table(made.groupBy("block").cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(_coded(sent), CODED), "class-sequences")
    model = docs.sparkSession.sparkContext.broadcast(fit(sequences, v, rounds))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, classes, n_tokens in _sequences(batches):
            found = model.value.log_probabilities(contexts(classes, n_tokens, v.classes, model.value.context), classes)
            by_text = np.add.reduceat(found, np.cumsum(n_tokens) - n_tokens) / np.log(10)
            ids = pa.array(unpack(row["doc_ids"], "<i8"), mask=unpack(row["nulls"], "u1").astype(bool))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(unpack(row["held"], "u1").astype(bool)), pa.array(n_tokens), pa.array(unpack(row["n_known"], "<i8")), pa.array(np.full(len(n_tokens), v.n)),
                pa.array(np.frombuffer(row["base"], "<f8")), pa.array(by_text + np.frombuffer(row["rest"], "<f8")),
            ], names)

    return sequences.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
