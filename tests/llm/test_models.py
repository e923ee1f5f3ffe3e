"""Language model, whitening, centroids and the dealing of keys against brute force, on small tables with odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewatch.llm import centroids, dealing, language_model, shared, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, x int, cluster string, component int"
BLANKS = " \t\n\x0b\x0c\r"


def odd_vectors(width, n=60, seed=4):
    rng = random.Random(seed)
    made = [(i, [round(rng.gauss(0, 0.4), 3) for _ in range(width)]) for i in range(n)]
    made += [made[0], made[0], (None, made[1][1]), (7, made[2][1]), (900, [0.0] * width), (901, [-0.0] * width)]
    return made + [(902, None), (903, [None] * width), (904, [math.nan] * width), (905, [math.inf] * width), (906, [1.0, -math.inf] * (width // 2)), (907, []), (908, [1.0] * (width + 1)), (909, [*[0.5] * (width - 1), None])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS).repartition(3)


def whole(v, width):
    return v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)


def floors(v, scale):
    return tuple(math.floor(scale * float(np.float32(c))) for c in v)


# 12


def whitened(df):
    return sorted(df.collect(), key=lambda r: (r.vec_id is not None, r.vec_id, r.component))


@pytest.mark.parametrize("width", [6, 40])
def test_whitening(spark, width):
    rows = odd_vectors(width)
    kept = [(i, floors(v, 256)) for i, v in rows if whole(v, width)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array(fit) - np.array(sums) / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1][:4], turn[:, ::-1][:, :4]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert Counter(r.vec_id for r in got) == Counter({i: 4 * k for i, k in Counter(i for i, _ in kept).items()})
    by_row = {}
    for i, x in kept:
        by_row.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), (np.array(x) - np.array(sums) / n) @ turn / np.sqrt(values)))
    signs = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(z.T @ z / n), rel=1e-9)
        same = [w[r.component - 1] for d, w in by_row[r.vec_id] if d == r.deviation]
        assert same and min(abs(abs(r.whitened) - abs(w)) for w in same) < 1e-8
        if len(by_row[r.vec_id]) == 1 and abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * same[0]))
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 4


def test_whitening_of_few_and_of_large_vectors(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    got = whitened(whitening.whiten(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0])])))  # one direction has variance
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.explained) for r in got] == [(1, 1, 2, 256**2, 1.0), (2, 1, 2, 256**2, 1.0), (2, 1, 2, 256**2, 1.0)]
    assert [abs(r.whitened) for r in got] == pytest.approx([1.0] * 3)
    got = whitened(whitening.whiten(frame(spark, [(1, [3e9]), (2, [-1.0]), (3, [0.0])])))
    x = [int(np.float32(3e9)) * 256, -256, 0]
    assert [int(r.deviation) for r in got] == [(3 * c - sum(x)) ** 2 for c in x]
    got = whitened(whitening.whiten(frame(spark, [(1, [3e38]), (2, [0.0])])))
    assert [r.component for r in got] == [1, 1] and all(math.isfinite(r.whitened) for r in got)


def test_lobpcg_against_a_dense_solver():
    rng = np.random.default_rng(0)
    for width, rank in ((1, 1), (3, 2), (30, 30), (30, 5), (80, 80)):
        half = rng.normal(size=(rank, width)) * np.linspace(1, 3, rank)[:, None]
        matrix = half.T @ half
        values, found, worst = whitening.lobpcg(lambda b, m=matrix: m @ b, width, 4)
        assert worst < 1e-10
        assert values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1][:4], abs=1e-9 * values[0])
        assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-10
    values, _, _ = whitening.lobpcg(lambda b: b * np.array([2.0, 2, 2, 1, 1])[:, None], 5, 4)
    assert values == pytest.approx([2, 2, 2, 1])


# 13


def plain_lloyd(kept, k, rounds, seed):
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    owner = lambda: [min(range(len(centres)), key=lambda c: (far(x, centres[c]), c)) for _, x in kept]
    for _ in range(rounds):
        now = owner()
        for c in range(len(centres)):
            own = [x for (_, x), o in zip(kept, now, strict=True) if o == c]
            if own:
                centres[c] = tuple(sum(d) // len(own) for d in zip(*own, strict=True))
    now = owner()
    dist = [far(x, centres[o]) for (_, x), o in zip(kept, now, strict=True)]
    inertia = Counter()
    for o, d in zip(now, dist, strict=True):
        inertia[o] += d
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, o, d, inertia[o], sum(dist), said[o]) for (i, _), o, d in zip(kept, now, dist, strict=True))


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 2), (100, 10)])
def test_centroids(spark, k, rounds):
    rows = odd_vectors(64)
    rows += [(1000 + i, [float(i % 2)] * 64) for i in range(20)]  # ties and many equal vectors
    kept = [(i, floors(v, 1024)) for i, v in rows if whole(v, 64)]
    got = centroids.cluster(frame(spark, rows), k, rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_lloyd(kept, k, rounds, centroids.SEED)


def test_centroids_of_few_and_of_large_vectors(spark):
    assert centroids.cluster(frame(spark, [])).collect() == []
    assert centroids.cluster(frame(spark, [(1, [1.0] * 63), (2, None)])).collect() == []
    got = centroids.cluster(frame(spark, [(None, [1.0] * 64)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == [(None, 0, 0, 0)]
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [2e5] * 64), (4, [3e5] * 64), (5, [0.0] * 64)]
    kept = [(i, tuple(max(-(1 << 63), min((1 << 63) - 1, c)) for c in floors(v, 1024))) for i, v in rows]
    want = {t[0]: t for t in plain_lloyd(kept, 2, 10, centroids.SEED)}
    for r in centroids.cluster(frame(spark, rows), 2).collect():
        i, c, distance, *_, said = want[r.vec_id]
        assert (r.cluster, r.distance, r.centroid_sha256) == (c, distance if distance < 1 << 63 else None, said)


def test_sums_beyond_longs(spark):
    x = np.array([[2**63 - 1, -(2**63)], [2**63 - 1, -5]])
    batch = vectors.sums_batch(*vectors.part_sums(np.c_[x, [1, 1]], np.array([1, 1]), 3))
    rows = spark.createDataFrame(pa.Table.from_batches([batch])).unionAll(spark.createDataFrame(pa.Table.from_batches([batch])))
    assert vectors.total_sums(rows, 3, 2) == [[0] * 3, [2 * (2**64 - 2), 2 * (-(2**63) - 5), 4], [0] * 3]


# 11


def corpus(n=120, seed=2):
    """Texts in which most words call for one of few successors."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    made = []
    for _ in range(n):
        at, text = rng.choice(words), []
        for _ in range(rng.randint(5, 200)):
            text.append(at if rng.random() < 0.9 else at.upper())
            at = words[(words.index(at) * 3 + rng.choice([1, 2])) % 30] if rng.random() < 0.9 else rng.choice(words)
        made.append(rng.choice(BLANKS).join(text))
    return [*made, "", None, " \t", "Été ÉTÉ été", "rare word   x\x1cy", "q" * 100_000, "w1 " * 50_000, made[0], made[0]]


def test_language_model(spark, monkeypatch):
    found = corpus()
    rows = [(i * 7 - 30, t) for i, t in enumerate(found)] + [(None, "w1 w2 new"), (-30, found[0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, n_tokens int").repartition(4)
    models, keep = [], language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *a: models.append((keep(*a), a[1])) or models[-1][0])
    got = Counter(tuple(r) for r in language_model.score(docs, top=20).collect())
    (model, v), split = models[0], lambda t: [*(t or "").encode().lower().translate(None, b"").split(), b""]
    counts = Counter(w for i, t in rows if not language_model.held_out(i) for w in split(t))
    n, mass = counts.total(), counts.total() + len(counts) + 1
    top = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    assert (v.words, v.n, v.distinct) == (top, n, len(counts))
    place, rest = {w: i for i, w in enumerate(top)}, mass - sum(counts[w] + 1 for w in top)
    assert model.noise.sum() == pytest.approx(1)
    r, q, c, b = (model.part(p).astype(float) for p in "rqcb")

    def log10(history, w):
        logits = q @ sum(r[a] @ c[j] for j, a in enumerate(history)) + b
        of = place.get(w, 20)
        found = (logits[of] - np.log(np.exp(logits).sum())) / np.log(10)
        return found + (math.log10((counts[w] + 1) / rest) if of == 20 else 0)

    want = {}
    for i, t in rows:
        words = split(t)
        some = words if len(words) < 1000 else words[:0]
        ids = [21] * 3 + [place.get(w, 20) for w in some]
        want.setdefault(i, []).append((language_model.held_out(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / mass) for w in words), sum(log10(ids[k : k + 3][::-1], w) for k, w in enumerate(some))))
    assert sum(got.values()) == len(rows)
    for i, *rest_, base, score in got.elements():
        same = [w for w in want[i] if list(w[:4]) == rest_ and base == pytest.approx(w[4], rel=1e-9)]
        assert same and score <= 0
        assert rest_[1] >= 1000 or any(score == pytest.approx(w[5], rel=1e-4, abs=1e-3) for w in same)


def test_language_model_learns_what_follows(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(1500, 5))), "doc_id long, text string")
    held = language_model.score(docs).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.3


def test_language_model_without_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score(none).collect() == []
    held = next(i for i in range(100) if language_model.held_out(i))
    got = language_model.score(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")).collect()
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(True, 1, 0, 0, 0.0, 0.0), (True, 3, 0, 0, 0.0, 0.0)]


def test_probabilities_add_up_to_one():
    model = language_model.Model(np.array([0.5, 0.3, 0.15, 0.05]))
    rng = np.random.default_rng(1)
    before, after = rng.integers(0, 5, (4000, 3)), rng.integers(0, 4, 4000)
    model.train(before, after, 1)
    every = np.array([model.log_probabilities(before, np.full(4000, w)) for w in range(4)])
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones(4000), abs=1e-5)
    flat = language_model.contexts(np.array([4, 5, 6, 7, 8]), np.array([3, 2]), 9, 3)
    assert flat.tolist() == [[9, 9, 9], [4, 9, 9], [5, 4, 9], [9, 9, 9], [7, 9, 9]]


def asked(spark, blocks):
    made = []
    for number, words in blocks.items():
        keys = sorted(set(words))
        rank, cells = dealing.dealt(keys, np.array([Counter(words)[k] for k in keys]), dealing.CELLS)
        made.append({"block": number, "asked": cells, "keys": [k for _, k in sorted(zip(rank.tolist(), keys, strict=True))]})
    schema = pa.schema([("block", pa.int64()), ("asked", dealing.ASKED_ARROW), ("keys", pa.list_(pa.binary()))])
    return shared.table(spark.createDataFrame(pa.Table.from_pylist(made, schema)).repartition(2), "asked")


def dealt_answers(made, **more):
    say = lambda keys, n: (n * 10 + np.array([len(k) for k in keys]), str(len(keys)).encode())
    found = dealing.answered(made, say, **more).collect()
    got = {}
    for row in made.collect():
        own = sorted((r.cell, bytes(r["values"])) for r in found if r.block == row.block)
        got[row.block] = dict(zip(map(bytes, row["keys"]), np.concatenate([dealing.unpack(v, "<i8") for _, v in own]).tolist(), strict=True))
    return got, sum(int(r["values"]) for r in found if r.block is None)


def test_keys_are_dealt_once_or_twice(spark, monkeypatch):
    rng = random.Random(6)
    blocks = {b: [f"{rng.randint(0, 400)}-{'x' * rng.randint(0, 3)}".encode() for _ in range(300)] for b in range(40)} | {99: [b""]}
    total = Counter(w for words in blocks.values() for w in words)
    want = {b: {w: total[w] * 10 + len(w) for w in words} for b, words in blocks.items()}
    monkeypatch.setattr(dealing, "CELLS", 4)
    once = asked(spark, blocks)
    assert dealt_answers(once) == (want, len(total))
    assert dealt_answers(once, shard=500, bundle=7) == (want, len(total))
    monkeypatch.setattr(dealing, "CELLS", 256)
    cells = asked(spark, blocks | {b + 100: w for b, w in blocks.items()}).select(F.max(F.size("asked"))).first()[0]
    assert cells <= 256  # whatever the number of blocks


def test_scratch_in_threads(spark, tmp_path):
    """Scratches of two threads of the driver don't take each other's folders away."""
    import threading

    inside, done, paths = threading.Event(), threading.Event(), {}

    def other():
        with shared.scratch(spark):
            paths["other"] = shared.written(spark.range(3).toDF("v"), "other")[1]
            inside.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    thread.start()
    assert inside.wait(60)
    with shared.scratch(spark):
        paths["own"] = shared.written(spark.range(4).toDF("v"), "own")[1]
    assert spark.read.parquet(paths["other"]).count() == 3
    done.set()
    thread.join()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    for path in paths.values():
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
