"""Changes against history against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagewatch.functions import text
from pagewatch.operators import changes, history

DAY = datetime.date(2024, 1, 1)


def test_as_of(spark):
    rng = random.Random(5)
    day = lambda: None if rng.random() < 0.05 else DAY + datetime.timedelta(rng.randint(0, 9))
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    value = lambda: rng.choice([None, None, "x", "y", "z"])
    held = [(key(), day(), value(), rng.choice([None, 1, 2])) for _ in range(150)]
    asked = [(key(), day(), i) for i in range(60)] + [("a", DAY, 1)] * 2
    now = spark.createDataFrame([(*r, 1, "s") for r in asked], "url string, run_date date, n int, as_of_date int, AS_OF_SIDE string")
    got = changes.as_of(now, spark.createDataFrame(held, "url string, run_date date, hash string, size long"), ["hash", "size"])
    assert got.columns == [*now.columns, "before_hash", "before_size"]

    def last(url, date, i):
        found = [r for r in held if r[0] == url and r[1] is not None and date is not None and url is not None and r[1] < date and r[i] is not None]
        return max(r[i] for r in found if r[1] == max(f[1] for f in found)) if found else None

    want = sorted(((u, d, n, last(u, d, 2), last(u, d, 3)) for u, d, n in asked), key=repr)
    assert sorted(((r.url, r.run_date, r.n, r.before_hash, r.before_size) for r in got.collect()), key=repr) == want
    assert changes.as_of(now.where("false"), got.selectExpr("url", "run_date", "'x' hash"), ["hash"]).count() == 0
    assert changes.as_of(now, got.where("false").selectExpr("url", "run_date", "'x' hash"), ["hash"]).where("before_hash is null").count() == len(asked)


def test_hash_status_with_repeated_history(spark):
    now = spark.createDataFrame([("a", "1", 3)], "url string, hash string, file_length long")
    old = spark.createDataFrame([("a", DAY, "9", 5), ("a", DAY + datetime.timedelta(1), "1", 2)], "url string, run_date date, hash string, file_length long")
    assert [tuple(r) for r in history.hash_status(now, old).collect()] == [("a", "same", 1)]
    assert [tuple(r) for r in history.hash_status(now, old.drop("run_date")).collect()] == [("a", "changed", -2)]


def test_alike_finds_every_pair_with_a_score(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.choice([300, 700, 1500, 4000]))) for _ in range(12)]
    made = list(base)
    for t in base:
        for _ in range(6):
            at, n = rng.randrange(len(t)), rng.randint(1, 200)
            made.append(t[:at] + rng.choice(["", "inserted " * rng.randint(1, 30)]) + t[at + n :])
    made += ["", "a", "a", "aaaaaaaaaaaaaaaa" * 50]
    rng.shuffle(made)
    signed = [text.fuzzy_hash_of(t.encode()) for t in made]
    now, before = signed[::2], signed[1::2]
    frame = lambda rows: spark.createDataFrame([(s, 1) for s in [*rows, None]], "signature string, score int")
    for least in (1, 60):
        want = {(a, b, s) for a in set(now) for b in set(before) if (s := text.fuzzy_score_of(a, b)) >= least}
        got = changes.alike(frame(now), frame(before), least).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len(want) > 20
    assert changes.alike(frame([]), frame(before)).count() == 0


def test_alike_where_all_share_a_passage(spark, monkeypatch):
    """Runs are never broadcast, and a run that all signatures have is dealt into blocks."""
    monkeypatch.setattr(changes, "BLOCK", 16)
    monkeypatch.setattr(changes, "PAIRS", 100)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    signed = [f"{rng.choice([3, 6, 48])}:{some(rng.choice([0, 1, 20]))}PASSAGES{some(rng.choice([0, 5, 50]))}:{some(6)}PASSAGES" for _ in range(160)] + ["3:" + "a" * 70 + "PASSAGES:b", "3:xPASSAGES?:b"]
    now, before = signed[::2], signed[1::2]
    frame = lambda rows: spark.createDataFrame([(s,) for s in rows], "signature string")
    for least in (1, 60):
        got = changes.alike(frame(now), frame(before), least)
        assert {tuple(r) for r in got.collect()} == {(a, b, s) for a in now for b in before if (s := text.fuzzy_score_of(a, b)) >= least}
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("old", "new", "expected"), [
    ("a b c d", "a b X d", [("modified", ["c"], ["X"])]), ("a b c", "a c", [("delete", ["b"], [])]), ("a c", "a b c", [("add", [], ["b"])]), ("", "a", [("add", [], ["a"])]), ("a a b", "a b", [("delete", ["a"], [])]),
    ("f { x } g { y }", "f { x } h { z } g { y }", [("add", [], ["h", "{", "z", "}"])]), ("1 a 2 b 3", "b 2 a", None),
])
def test_patience(old, new, expected):
    got = text.line_changes(old.split(), new.split())
    if expected is not None:
        assert got == expected


def test_patience_gives_the_new_text():
    rng = random.Random(1)
    for _ in range(600):
        words = "abcdefghij"[: rng.randint(1, 10)]
        old, new = ([rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(2))
        if rng.random() < 0.5:
            new = old[: rng.randint(0, 30)] + new[:3] + old[rng.randint(0, 30) :]
        made, at = [], 0
        for a, b, c, d in text._gaps(old, new):
            made += old[at:a]
            assert len(made) == c and (a < b or c < d)
            made += new[c:d]
            at = b
        assert made + old[at:] == new
    big = [f"line {i}" for i in range(200_000)]
    assert text._gaps(big, big[:5] + ["x"] + big[6:100_000] + big[100_002:]) == [(5, 6, 5, 6), (100_000, 100_002, 100_000, 100_000)]
    assert len(text._gaps(["same"] * 100_000 + ["a"], ["same"] * 50_000 + ["b"])) == 1


def test_changed_lines(spark):
    rows = spark.createDataFrame([("a\nb", "a\nc"), (None, "x"), ("x", None), ("same", "same"), ("", "y")], "before string, now string")
    got = {r.now: (r.old_length, r.new_length, [(c.kind, c.old, c.new) for c in r.changes]) for r in changes.changed_lines(rows, "now", "before").collect()}
    assert got == {"a\nc": (3, 3, [("modified", ["b"], ["c"])]), "y": (0, 1, [("add", [], ["y"])])}


def test_signature_parts(spark):
    row = spark.createDataFrame([("3:abcdefgh:xyzxyzxyz",), ("6:abc:",), (None,)], "s string").select(changes.signature_parts(F.col("s")).alias("p")).collect()
    assert {tuple(x) for x in row[0].p} == {(3, "abcdefg"), (3, "bcdefgh"), (6, "xyzxyzx"), (6, "yzxyzxy"), (6, "zxyzxyz")}
    assert row[1].p == [] and not row[2].p


def test_numbered(spark):
    words = [f"w{i:04d}" for i in range(500)] + ["a", "z", "w0001"]
    rows = spark.createDataFrame([(w,) for w in words], "tag string").repartition(5)
    assert {r.tag: r.code for r in history.numbered(rows, "tag").collect()} == {w: i for i, w in enumerate(sorted(set(words)))}
    assert history.numbered(rows.where("false"), "tag").count() == 0
