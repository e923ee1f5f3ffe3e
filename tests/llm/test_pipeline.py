"""The pipeline against a brute-force version, stage by stage."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewatch.llm import near_copies


def make(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 150))) for _ in range(160)]
    for i in range(0, 60, 3):
        texts[i] += " moron scum" * (1 + i % 3)
    texts += [texts[1]] * 4 + [texts[2]] * 2
    for i in (4, 5, 7):
        own = texts[i].split()
        own[len(own) // 2] = "changed"
        texts.append(" ".join(own))
    items = ["Question: " + " ".join(word() for _ in range(14)), "too few"]
    texts += [texts[8] + " " + items[0].upper() + " " + word(), "", "!!", "x " + items[1] + " y"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "a text of its own", None, "s", 1), (901, "a text of its own", None, "s", 1), (None, "a text without an id", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("node", "digest", "keep_id", "n", "doc_id_gone", "Node_Gone", "_digest", "_keep_id", "_rows", "_node", "_doc_id")})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60 and i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    return folder, *make(spark, folder)


def brute(rows, items):
    rows = [(i, t or "") for i, t, *_ in rows]
    rows = [(i, t) for i, t in rows if "moron" not in t]
    yield rows
    best = {}
    for i, t in rows:
        best[t] = i if t not in best or best[t] is None else max(best[t], i if i is not None else best[t])
    rows = [(i, t) for t, i in best.items()]
    yield rows
    sets = [set(near_copies.shingles(t.encode()).tolist()) for _, t in rows]
    groups = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = groups[a], groups[b]
                groups = [new if g == old else g for g in groups]
    least = defaultdict(list)
    for g, (i, _) in zip(groups, rows, strict=True):
        least[g].append(i)
    rows = [(i, t) for g, (i, t) in zip(groups, rows, strict=True) if i == min((x for x in least[g] if x is not None), default=None)]
    yield rows
    tests = [item.lower().replace(":", "").split() for item in items]

    def hit(text):
        found = text.lower().replace("!", "").split()
        for own in tests:
            n = min(10, len(own))
            parts = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            if any(tuple(found[i : i + n]) in parts for i in range(len(found) - n + 1)):
                return True
        return False

    yield [(i, t) for i, t in rows if not hit(t)]


def test_stages(spark, made):
    folder, rows, items = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows, items), strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        got = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
        assert got == sorted(want, key=repr), name
    *_, last = brute(rows, items)
    pieces = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in pieces.collect()} == {i for i, _ in last}


def test_empty_tables(spark, made, tmp_path):
    folder, *_ = made
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
