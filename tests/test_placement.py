"""Placement trees against brute force."""

import math
import random
from collections import Counter, defaultdict

from pagewatch.operators import placement

WEIGHT = placement.WEIGHTS


def entropy(weights):
    whole = sum(weights)
    return -sum(w / whole * math.log2(w / whole) for w in weights if w)


def grow(rows, depth, node=0):
    """Splits of one key: rows of (around, label, n)."""
    weigh = lambda some: [sum(n * WEIGHT[c] for _, label, n in some if label == c) for c in range(3)]
    total, best = weigh(rows), None
    if not depth:
        return {}
    for place in range(len(rows[0][0])):
        for tag in sorted({r[0][place] for r in rows}):
            left = weigh([r for r in rows if r[0][place] == tag])
            right = [t - x for t, x in zip(total, left, strict=True)]
            if not sum(right):
                continue
            gain = round(entropy(total) - (sum(left) * entropy(left) + sum(right) * entropy(right)) / sum(total), 9)
            if gain > placement.LEAST_GAIN and (best is None or gain > best[0] + 5e-10):
                best = (gain, place, tag)
    if best is None:
        return {}
    _, place, tag = best
    out = {node: (place, tag, *total)}
    out |= grow([r for r in rows if r[0][place] == tag], depth - 1, 2 * node + 1)
    return out | grow([r for r in rows if r[0][place] != tag], depth - 1, 2 * node + 2)


def some_pages(n=120):
    rng = random.Random(9)
    made = [("lone", "<p><p><b>"), ("none", None), ("none", ""), (None, "<p><iframe src=x width=9 height=9></iframe><b>")]
    for i in range(n):
        host = rng.choice(["a", "a", "b", "c"])
        body = [rng.choice(["<p>", "<b>", "<DIV>", "<br/>", "text", "<!-- <iframe> -->", "<a href='<i>'>"]) for _ in range(rng.randint(0, 14))]
        if i % 3:
            body.insert(rng.randint(0, len(body)) if host == "b" else len(body) // 2, rng.choice(["<iframe width=300 height=20 src=x></iframe>", "<IFRAME width=0 height=0>"]))
        made.append((host, "".join(body)))
    return made


def test_elements_and_trees(spark):
    pages = spark.createDataFrame([(h, p, "x", 1) for h, p in some_pages()], "host string, html string, key string, names int")
    rows = placement.elements(pages, "host", "html", 2)
    by_key = defaultdict(list)
    for r in rows.collect():
        by_key[r.key].append((tuple(r.around), r.label, r.n))
    assert Counter({(a, label): n for a, label, n in by_key[None]}) == {(("", "", "iframe", "b"), 0): 1, (("", "p", "b", ""), 1): 1, (("p", "iframe", "", ""), 0): 1}
    assert sorted(by_key["lone"]) == [(("", "", "p", "b"), 0, 1), (("", "p", "b", ""), 0, 1), (("p", "p", "", ""), 0, 1)]
    assert {label for k in "abc" for _, label, _ in by_key[k]} == {0, 1, 2}
    for depth in (3, 12):
        splits = placement.train(rows, depth)
        got = defaultdict(dict)
        for r in splits.collect():
            got[r.key][r.node] = (r.place, r.tag, r.w0, r.w1, r.w2)
        want = {k: tree for k, own in by_key.items() if (tree := grow(own, depth))}
        assert dict(got) == want
        assert "lone" not in got and None in got
    at, want = defaultdict(lambda: [0, 0, 0]), Counter()

    def leaf(key, around):
        node = 0
        while node in got[key]:
            place, tag, *_ = got[key][node]
            node = 2 * node + (1 if around[place] == tag else 2)
        return key, node

    for key, own in by_key.items():
        for around, label, n in own:
            at[leaf(key, around)][label] += n * WEIGHT[label]
    for key, own in by_key.items():
        for around, label, n in own:
            weights = at[leaf(key, around)]
            want[key, label, weights.index(max(weights))] += n
    assert Counter({(r.key, r.label, r.said): r.n for r in placement.placed(rows, rows, splits).collect()}) == want
    new = spark.createDataFrame([("q", ["", "", "", ""], 1, 2), ("a", ["new", "new", "new", "new"], 0, 1)], rows.schema)
    assert {(r.key, r.label) for r in placement.placed(new, rows, splits).collect()} == {("q", 1), ("a", 0)}


def test_no_elements(spark):
    none = placement.elements(spark.createDataFrame([], "host string, html string"), "host", "html")
    assert none.count() == 0 and placement.train(none).count() == 0
