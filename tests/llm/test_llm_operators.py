"""The operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewatch.llm import decontaminate, exact_dedup, near_copies, packing, pretokens, quality, queries, simhash, suffix_dedup, token_counts, toxicity, url_filter, warc

DOCS = "doc_id long, text string, digest string, seed int, node string, block string, item string, shard int"
EXTRA = ("x", 1, "n", "b", "i", 2)


def some_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["the", "and", "ñandú", "été", "x1", "it's", "we'll", "漢字", "😀", "--", "1234", "Straße", "ΑΣ", "<|endoftext|>", "İ", "\u200b", "e\u0301"]
    words += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    made = [rng.choice([" ", "  ", "\n", " "]).join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    made += made[:6] + [made[1] + " tail", "", "", " \n ", "idiot " * 40, "a" * 5000]
    return made


@pytest.fixture(scope="module")
def rows():
    found = [(i * 3 - 20, t) for i, t in enumerate(some_texts())]
    return [*found, (500, None), (501, None), found[2], found[2], (None, "no id"), (None, found[3][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def raw(text):
    return (text or "").encode()


# 1


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        groups[raw(t)].append(i)
    want = Counter((i, hashlib.sha256(raw(t)).digest(), max((x for x in groups[raw(t)] if x is not None), default=None), len(groups[raw(t)])) for i, t in rows)
    got = Counter((r.doc_id, bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.dedup(docs).collect())
    assert got == want
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_duplicates_of_two_tables(spark):
    """History and what comes in: members, strangers, texts that only come in, repeats, nulls, and empty sides."""
    history = spark.createDataFrame([(5, "a"), (9, "b"), (2, "b"), (None, None)], "doc_id long, text string")
    incoming = spark.createDataFrame([(7, "a"), (1, "c"), (3, "c"), (None, "d"), (4, "")], "doc_id long, text string")

    def groups(old, new):
        return {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(old, new).collect()}

    of = lambda t: hashlib.sha256(t.encode()).digest()
    assert groups(history, incoming) == {of("a"): (7, 2), of("b"): (9, 2), of("c"): (3, 2), of("d"): (None, 1), of(""): (4, 2)}
    assert groups(history.where("false"), incoming) == {of("a"): (7, 1), of("c"): (3, 2), of("d"): (None, 1), of(""): (4, 1)}
    assert groups(history, incoming.where("false")) == {of("a"): (5, 1), of("b"): (9, 2), of(""): (None, 1)}
    assert groups(history.where("false"), incoming.where("false")) == {}


@given(st.sets(st.binary(min_size=32, max_size=32), min_size=1, max_size=300))
@settings(max_examples=20, deadline=None)
def test_perfect_hash(found):
    found = sorted(found)
    slots = exact_dedup._matrix(found)
    hashed = exact_dedup.PerfectHash.build(slots)
    listed = int(hashed.ranks[-1])
    numbers = [n for n in hashed.number(slots).tolist() if n < listed]
    assert sorted(numbers) == list(range(listed))
    shard = exact_dedup.Shard(exact_dedup.build_shard(found, np.arange(len(found)), np.ones(len(found), np.int64)))
    assert [shard.slots[i].tobytes() for i in shard.find(slots)] == found
    assert shard.winners[shard.find(slots)].tolist() == list(range(len(found)))
    strangers = exact_dedup._matrix([hashlib.sha256(d).digest() for d in found])
    assert (shard.find(strangers) == -1).all()


def test_perfect_hash_with_like_halves():
    """Digests that agree in the hashed bytes are listed, and still told apart."""
    found = [b"\1" * 16 + bytes([i]) * 16 for i in range(5)]
    shard = exact_dedup.Shard(exact_dedup.build_shard(found, np.arange(5), np.ones(5, np.int64)))
    assert [shard.slots[i].tobytes() for i in shard.find(exact_dedup._matrix(found))] == found
    assert shard.find(exact_dedup._matrix([b"\1" * 16 + b"\x09" * 16])).tolist() == [-1]


# 2, 3


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pretokens(name, words):
    own = pretokens.PreTokenizer(queries.vocabulary(name), words)
    found = some_texts(200, 7) + ["'s't 're", "a'st", " 's", "\n's", "''s", "x  'll", "1²Ⅷ\u0085y", "\x1c\x0b", "<|startoftext|>a", "don't'd"]
    tokens, owner = own.split(found)
    codes, distinct = pretokens.coded(tokens)
    ids, by_text = own.ids(distinct), [[] for _ in found]
    for o, c in zip(owner.tolist(), codes.tolist(), strict=True):
        by_text[o] += ids[c]
    assert by_text == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in found]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(pretokens, "SEGMENT", 50)
    own = pretokens.PreTokenizer(queries.vocabulary("byte_bpe_50k.json"), False)
    text = " ".join(some_texts(20, 3))
    tokens, _ = own.split([text])
    assert [i for ids in own.ids(tokens.to_pylist()) for i in ids] == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 900)
    name = queries.vocabulary("word_bpe_49k.json")
    library = pretokens.load(name)
    want = Counter((i, len(raw(t)), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, name).collect()) == want
    assert token_counts.token_counts(empty, name).count() == 0
    assert token_counts.token_counts(docs.where("text is null"), name).where("n_tokens = 0 AND n_bytes = 0").count() == 2


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_pack(sizes):
    sizes = np.array(sizes) + 1
    made = packing.pack(sizes)
    cover = defaultdict(list)
    for sequence in made:
        assert 0 < sum(n for _, _, n in sequence) <= packing.LIMIT
        for item, start, n in sequence:
            cover[item] += range(start, start + n)
    assert all(sorted(cover[i]) == list(range(n)) for i, n in enumerate(sizes.tolist()))
    fills = [sum(n for _, _, n in s) for s in made]
    assert sum(packing.LIMIT - f for f in fills if f & (f - 1)) < packing.TOP_UP * len(fills)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=50))
@settings(max_examples=50, deadline=None)
def test_first_fit_decreasing(sizes):
    bins = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        own = next((b for b in bins if sum(sizes[i] for i in b) + sizes[item] <= 100), None)
        own.append(item) if own is not None else bins.append([item])
    assert packing.first_fit_decreasing(np.array(sizes), 100) == bins


def test_packing(docs, rows, empty):
    name = queries.vocabulary("byte_bpe_50k.json")
    library, groups, sequences = pretokens.load(name), defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, name).collect():
        groups[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    assert set(groups) == set(want)
    for i, pieces in groups.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
                at += p.length
    assert packing.packed(empty, name).count() == 0


# 4, 5


def labelled(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        toxic, quality_ = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(["moron", "trashy", "trashes", "scum"])
        if not quality_:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, quality_, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, rows, empty):
    own, labels = labelled(spark)
    model = toxicity.fit(own, labels.unionByName(spark.createDataFrame([(None, None, None)], labels.schema)))
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(own, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.toxic == bool(truth[i]) for i, r in got.items())
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in got.values())
    assert toxicity.score(docs, model).count() == len(rows)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(own, labels.where("false"))
    assert toxicity.score(own, none).where("toxic").isEmpty()


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = np.searchsorted([-1.0, 0.5, 1.5], x @ [2.0, -1.0, 0.0] + rng.logistic(size=300) * 0.3)
    w, cuts = toxicity.fit_ordinal(toxicity.Sparse.of([(np.arange(3), row) for row in x], 3), y, np.ones(300))
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0] and (np.diff(cuts) > 0).all()


def test_quality(spark, docs, rows, empty):
    own, labels = labelled(spark)
    got = quality.quality(own, labels).join(labels, "doc_id").collect()
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality(docs, labels.where("false")).where("score = 0.5").count() == len(rows)
    assert quality.quality(empty, labels).count() == 0


def test_quality_never_learns_from_held_out_rows(spark):
    own, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r.doc_id, r.score) for r in quality.quality(own, x).collect()) for x in (labels, other))
    assert np.allclose(one, two)


def test_quality_is_fitted_on_a_bounded_number_of_rows(spark, monkeypatch):
    own, labels = labelled(spark)
    first = own.join(labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    many = own.unionByName(first.crossJoin(spark.range(3000)).select(own.columns))
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(y)) or train(x, y))
    one = quality.quality(many, labels)
    assert one.count() == many.count() and seen == [labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).count()]
    assert quality.quality(many, labels, bound=10).count() == many.count() and seen[1] == 10


# 6


def test_viterbi():
    counts = {"cheap": 50, "pills": 40, "che": 3, "ap": 9, "a": 90, "p": 5, "ills": 2}

    def best(word):
        options = {"": (0.0, [])}
        for end in range(1, len(word) + 1):
            found = []
            for start in range(end):
                w = word[start:end]
                p = np.log(counts[w] / 200) if w in counts else np.log(10 / 200) - len(w) * np.log(10)
                found.append((options[word[:start]][0] + p, [*options[word[:start]][1], w]))
            options[word[:end]] = max(found, key=lambda x: x[0])
        return options[word][1]

    for word in ("cheappills", "apills", "zzcheap", "p"):
        known = {(i, n): np.log(counts[word[i : i + n]] / 200) for i in range(len(word)) for n in range(1, len(word)) if word[i : i + n] in counts}
        if word in counts:
            known[0, len(word)] = np.log(counts[word] / 200)
        assert url_filter.viterbi(word, known, 200.0) == best(word)


def brute_judge(rows):
    """The rules by hand, every split of a host's pieces, and the Bayes model by its formula."""
    import re

    words = lambda t: re.findall("[a-z]+", (t or "").lower())
    unigram = Counter(w for _, _, h in rows for w in words(h))
    total = sum(unigram.values()) or 1

    def split(piece):
        best = {0: (0.0, [])}
        for end in range(1, len(piece) + 1):
            found = [(best[s][0] + (np.log(unigram[w] / total) if w in unigram else np.log(10 / total) - len(w) * np.log(10)), [*best[s][1], w]) for s in range(end) for w in [piece[s:end]]]
            best[end] = max(found, key=lambda x: x[0])
        return best[len(piece)][1]

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        host, path = re.fullmatch("([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    def rule_of(host, path):
        fits = [(k, h, p) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        kind, h, p = max(fits, key=lambda r: len(r[1] + r[2]), default=(None, "", ""))
        return (h + p) if kind else None, kind

    made = []
    for i, url, _ in rows:
        host, path = parts(url)
        made.append((i, host, path, *rule_of(host, path), [w for piece in words(host) for w in split(piece)] + words(path)))
    counts = {k: Counter(w for *_, kind, ws in made if kind == k for w in ws) for k in ("allow", "block")}
    n = {k: sum(kind == k for *_, kind, _ in made) for k in counts}
    known = set(counts["allow"]) | set(counts["block"])
    of = lambda w, k: (counts[k][w] + 1) / (sum(counts[k].values()) + len(known))
    for i, host, path, rule, kind, ws in made:
        unit = lambda p: round(float(np.log(p)) * 1_000_000)
        score = unit((n["block"] + 1) / (n["allow"] + 1)) + sum(unit(of(w, "block") / of(w, "allow")) for w in ws if w in known)
        yield i, host, path, rule, kind or ("block" if score > 0 else "allow"), round(score / 1_000_000, 6)


def test_url_filter(spark):
    cases = [
        (1, "http://a.COM/x", "a.com", "/x", "com/", "allow"), (2, "https://q.example.com/en/1?u", "q.example.com", "/en/1", "example.com/en/", "block"),
        (3, "http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), (4, "http://b.net/es/#f", "b.net", "/es/", "net/es/", "block"),
        (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"), (7, "http://freebets-casino-win.org/de/", "freebets-casino-win.org", "/de/", None, "block"),
        (8, "http://library.org/en/", "library.org", "/en/", None, "allow"), (9, "http://mycom", "mycom", "", None, "allow"), (9, "http://mycom", "mycom", "", None, "allow"), (None, "x://net", "net", "", None, None),
        (10, "http://" + "ab" * 400 + ".org/" + "long/" * 2000, "ab" * 400 + ".org", "/" + "long/" * 2000, None, None), (11, "http://Ünï.example.com/EN/x", None, None, None, None),
    ]
    rng, rows = random.Random(6), [(i, u, "<p>the library of free bets and books</p>" if i != 4 else None) for i, u, *_ in cases]
    names = ["casino", "win", "bets", "free"], ["library", "books", "reading", "my"]
    for i in range(300):
        bad = rng.random() < 0.4
        host = "".join(rng.sample(names[0 if bad else 1], 2)) + rng.choice(["", "-" + rng.choice(names[0 if bad else 1])])
        rows.append((100 + i, f"http://{host}.{'example.com/en/' if bad else 'com/en/'}{i}", "casino win books reading " * (i % 3)))
    pages = spark.createDataFrame([(*r, "h", "v", "w") for r in rows], "page_id long, url string, html string, host string, verdict string, words string").repartition(3)
    got = url_filter.judge(pages).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6)) for r in got) == Counter(brute_judge(rows))
    by_id = {r.page_id: r for r in got}
    for i, _, host, path, rule, verdict in cases:
        assert host is None or (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule)
        assert verdict is None or by_id[i].verdict == verdict, i
    none = url_filter.judge(pages.where("url like '%.org/%'"))
    assert none.count() == 3 and none.where("verdict <> 'allow' OR score <> 0").isEmpty()
    assert url_filter.judge(pages.where("false")).count() == 0


# 7


def spec_fingerprint(text):
    import xxhash

    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b < 91 else b for b in raw(text))) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(120), 2), reverse=True)) for _ in range(70)} | {(i + 1, i) for i in range(200, 260)} | {(500, i) for i in range(300, 330)}
    want = roots(600, [(a, b) for a, b in pairs])
    edges = spark.createDataFrame([*pairs, (5, 5)], "hi long, lo long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: want[i] for i in {x for p in pairs for x in p} if want[i] != i}
    assert simhash.components(edges.where("false")).count() == 0


def near_rows(seed=5):
    rng = random.Random(seed)
    base = [[rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(30, 120))] for _ in range(12)]
    made = []
    for words in base:
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "zz"
            made.append(" ".join(own))
    return made


@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash(spark, docs, rows, empty, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    every = rows + [(1000 + i, t) for i, t in enumerate(near_rows())]
    fps = [spec_fingerprint(t) for _, t in every]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root, least = roots(len(fps), pairs), {}
    for i, r in enumerate(root):
        if every[i][0] is not None:
            least[r] = min(least.get(r, every[i][0]), every[i][0])
    want = Counter((d, f, least.get(r)) for (d, _), f, r in zip(every, fps, root, strict=True))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(every[len(rows) :], "doc_id long, text string"))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(both).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_pigeonhole_keys():
    """Any two fingerprints within three bits share a key, and share one again after each split."""
    rng, masks = random.Random(2), simhash._block_masks()
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        own = [m for m in masks if not m & x]
        assert own and any(not m & x for m in simhash._split_mask(own[0]))


# near copies


def brute_roots(found):
    sets = [set(near_copies.shingles(raw(t)).tolist()) for t in found]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    return roots(len(found), [(i, j) for i in range(len(found)) for j in range(i) if like(sets[i], sets[j])])


def kept_by_near_copies(spark, found):
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.keep_id for r in near_copies.near_copies(docs).collect()}
    return [got.get(i, i) for i in range(len(found))]


def passages(seed=8):
    """Texts with scattered, added, replaced and moved words, families round one text, and a line that many share."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, found = some(12), []
    for n in (40, 90, 300, 1500):
        for _ in range(6 if n < 1000 else 2):
            base, more, at = some(n), some(round(n * rng.uniform(0.08, 0.24))), rng.randrange(n // 2)
            scattered = [w if rng.random() > 0.02 else "zz" for w in base]
            moved = base[at + n // 3 :] + base[: at + n // 3]
            found += [base, more + base, base[: n // 2] + line + base[n // 2 :], base + more, base[:at] + more + base[at + len(more) :], scattered, moved]
    family = some(100)
    found += [family + some(18) for _ in range(40)] + [line + some(3) for _ in range(12)] + [some(80) + line for _ in range(30)]
    found += [[w.upper() for w in family], [], ["one"], ["ONE"], ["one", "two"]]
    rng.shuffle(found)
    return [" ".join(t) for t in found]


@pytest.mark.parametrize(("pairs", "hot"), [(64, 3), (2, 1), (64, 10**9), (0, 1)])
def test_near_copies(spark, monkeypatch, pairs, hot):
    """Every similar pair is joined, and no other, whatever the constants that only set the order of work."""
    monkeypatch.setattr(near_copies, "PAIRS_A_TEXT", pairs)
    monkeypatch.setattr(near_copies, "HOT", hot)
    found = passages() + near_rows()
    assert kept_by_near_copies(spark, found) == list(brute_roots(found))


def test_near_copies_of_odd_rows(spark, docs, rows, empty):
    want = brute_roots([t for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, want, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    several = {r for r in want if len({raw(t) for (_, t), w in zip(rows, want, strict=True) if w == r}) > 1}
    assert several
    expected = Counter((i, least.get(r)) for (i, _), r in zip(rows, want, strict=True) if r in several)
    assert Counter((r.doc_id, r.keep_id) for r in near_copies.near_copies(docs).collect()) == expected
    assert near_copies.near_copies(empty).count() == 0


def test_repeated_over_batches():
    import pyarrow as pa

    rng = random.Random(4)
    x = sorted((rng.randrange(40), rng.randrange(5), 7) for _ in range(150))
    n = Counter(h for h, _ in {r[:2] for r in x})
    want = sorted(r for r in set(x) if n[r[0]] > 1)
    for size in (1, 2, 7, 150):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*x[i : i + size], strict=True)], near_copies.MET) for i in range(0, len(x), size)]
        assert [tuple(r.values()) for b in near_copies._repeated(iter(batches)) for r in b.to_pylist()] == want


# 8


@pytest.mark.parametrize("parts", [1, 7])
def test_warc(spark, monkeypatch, parts):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i, f"http://h{i % 3}.x.org/p{i % 4}", ["<p>a</p>", "é" * 40, "", None, f"own {i}"][i % 5]) for i in range(30)]
    rows += [rows[4], rows[0], (None, "http://n.org/", "null id"), (None, "http://n.org/", "null id"), (77, None, "no url"), (78, "odd url\r\n?x", "odd"), (79, "a://b", None)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, offset int").repartition(parts)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[raw(h)].append(i)

    def expected(i, h):
        first = min((x for x in groups[raw(h)] if x is not None), default=None)
        revisit = first is not None and first != i
        return i, len(raw(h)), warc.base32_sha1(raw(h)), "revisit" if revisit else "response", first if revisit else None

    assert Counter(tuple(r) for r in warc.archive(pages).collect()) == Counter(expected(i, h) for i, _, h in rows)
    assert warc.archive(pages.where("false")).count() == 0
    least = warc.archive(pages, min_revisit=5)
    assert {r.record_type for r in least.where("payload_bytes < 5").collect()} == {"response"}


def test_surt():
    assert warc.surt("http://www.Example.com/a?b#c") == "com,example,www)/a?b#c"
    assert warc.surt("x y") == "x%20y" and warc.surt(None) == ""


# 9


def brute_repeats(rows, length=100):
    seen, out = set(), Counter()
    for i, t in rows:
        data = raw(t)
        gone = np.zeros(len(data) + 1, int)
        for at in range(len(data) - length + 1):
            if data[at : at + length] in seen:
                gone[at] += 1
                gone[at + length] -= 1
            seen.add(data[at : at + length])
        mask = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        out[i, len(data), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("hot", "stretch"), [(4096, 1 << 19), (3, 700)])
def test_repeated_passages(spark, docs, rows, empty, monkeypatch, hot, stretch):
    for name, value in (("HOT", hot), ("STRETCH", stretch), ("BLOCK", 6000), ("CHUNK", 4000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    more = [(2000 + i, "".join(rng.choice("xyzw ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 150) :] + str(i)) for i in range(30)]
    more += [(3000, "tick " * 300), (3001, "tick " * 25), (3002, "ab" * 400)]
    every = [r for r in rows if r[0] is not None] + more
    own = docs.where("doc_id is not null").select("doc_id", "text", "block").unionByName(spark.createDataFrame([(*r, "b") for r in more], "doc_id long, text string, block string"))
    got = Counter(tuple(r) for r in suffix_dedup.repeated_passages(own).collect())
    assert got == brute_repeats(sorted(every, key=lambda r: r[0]))
    assert suffix_dedup.repeated_passages(docs.where("doc_id is null")).count() == 2
    assert suffix_dedup.repeated_passages(empty).count() == 0


@given(st.lists(st.text("ab", min_size=9, max_size=60).map(str.encode), min_size=1, max_size=10), st.randoms())
@settings(max_examples=60, deadline=None)
def test_interval_expansion(snippets, rng):
    order = np.array(rng.sample(range(50), len(snippets)))
    starts = np.array([rng.randint(0, 9) for _ in snippets])
    seen = defaultdict(list)
    for s, o, at in zip(snippets, order, starts, strict=True):
        for i in range(len(s) - 8):
            seen[s[i : i + 9]].append((o, at + i))
    for s, o, at, got in zip(snippets, order, starts, suffix_dedup.repeated_starts(snippets, order, starts, 9), strict=True):
        assert got.tolist() == [min(seen[s[i : i + 9]]) < (o, at + i) for i in range(len(s) - 8)]


# 10


def brute_hits(text, items, window=10):
    import re

    def words(value):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))

    found, hit, ids = words(text), set(), set()
    for item, own in items:
        own = words(own)
        for at in range(max(1, len(own) - window + 1) if own else 0):
            part = own[at : at + window]
            for i in range(len(found) - len(part) + 1):
                if found[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    ids.add(str(item) if item is not None else "null")
    return len(found), len(hit), sorted(ids)


def test_decontaminate(spark, docs, rows, empty):
    source = next(t for i, t in rows if t and len(t) > 300)
    items = [(3, source[20:140]), (11, "idiot Idiot, IDIOT"), (4, None), (5, "!!"), (11, "no such words here"), (None, source[150:260]), (3, source[20:140])]
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.decontaminate(docs, benchmark).collect())
    want = {t: brute_hits(t, items) for _, t in rows}
    assert got == Counter((i, want[t][0], want[t][1], tuple(want[t][2])) for i, t in rows)
    for r in decontaminate.decontaminate(docs.where("text is not null"), benchmark).join(docs.where("doc_id is not null"), "doc_id").where("n_hit > 0").collect():
        assert sum(len(decontaminate.words(raw(r.text)[s.start : s.end])) for s in r.spans) == r.n_hit
    kept = decontaminate.keep_uncontaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(1 for _, t in rows if not want[t][1])
    assert decontaminate.decontaminate(docs, benchmark.where("false")).where("n_hit > 0").isEmpty()
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=5), st.lists(st.integers(0, 4), max_size=80), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_automaton(items, text, window):
    """Few words, so that pieces, windows and short items overlap in every way."""
    made = [(str(i), " ".join(f"w{w}" for w in item).encode()) for i, item in enumerate(items)]
    found = " ".join(f"w{w}" for w in text)
    n, mask, ids = decontaminate.Automaton(made, window).scan(found.encode())
    want = brute_hits(found, [(i, t.decode()) for i, t in made], window)
    assert (n, 0 if mask is None else int(mask.sum()), sorted(ids)) == want


def test_decontaminate_long_text(spark):
    """Some MB of text, with a window at its very end."""
    words = [f"v{i % 977}" for i in range(400_000)]
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, " ".join(words) + " " + item), (2, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.spans) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    size = len(" ".join(words)) + 1
    assert got == {1: (400_012, 12, [(size, size + len(item))]), 2: (400_000, 0, [])}


# what holds for all


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(350_000)]
    tail = [rng.choice(words) for _ in range(20_000)]
    return [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base + tail)), (4, "x" * 3_000_000), (5, " ".join(tail[:50]))]


def test_texts_of_some_mb(spark, long_rows):
    """Whole texts count: what stands at the end of 2 MB is seen, by the library's counts, digests, fingerprints and spans."""
    docs = spark.createDataFrame(long_rows, "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}
    name = queries.vocabulary("word_bpe_49k.json")
    library = pretokens.load(name)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, name).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in long_rows}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()} == {i: spec_fingerprint(t) for i, t in long_rows}
    assert {r.doc_id: r.keep_id for r in near_copies.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 1}
    name = queries.vocabulary("byte_bpe_50k.json")
    pieces = packing.packed(docs.where("doc_id in (1, 5)"), name).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in pieces} == {i: (n, n) for i, t in long_rows if i in (1, 5) for n in [len(pretokens.load(name).encode(t, add_special_tokens=False).ids) + 1]}
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_passages(docs.where("doc_id <> 3")).collect()}
    size = len(long_rows[0][1])
    assert gone == {1: (size, 0), 2: (size, size), 4: (3_000_000, 2_999_999), 5: (len(long_rows[4][1]), 0)}


def test_settings_and_folders_are_left_as_they_were(spark, tmp_path):
    import os

    from pagewatch.llm import shared

    name, folder = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    spark.conf.set(name, "1234")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)) + f" {i}") for i in range(20)], "doc_id long, text string")
    found = near_copies.near_copies(docs)
    assert spark.conf.get(name) == "1234" and len(set(os.listdir(folder)) - before) == 1 and found.count() > 0
    with shared.scratch(spark):
        shared.table(docs, "inner")
        kept = shared.table(docs, "outer", keep=True)
    assert kept.count() == 20 and len([x for x in set(os.listdir(folder)) - before if "inner" in x]) == 0
    spark.conf.set(name, "10000")


def test_models_do_not_depend_on_the_order_of_rows(spark):
    """Repeated doc_ids, equal texts with both labels, and rows in another order and number of partitions."""
    own, labels = labelled(spark, 200)
    rows = own.collect()
    rows += [(i, rows[0].text) for i in (500, 501)] + [(r.doc_id, r.text + " again") for r in rows[:20]]
    labels = labels.unionByName(spark.createDataFrame([(500, 1, 1), (501, 0, 0), (501, 1, 0)], labels.schema))
    scores = []
    for seed, parts in ((1, 2), (2, 5)):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        toxic = {(r.doc_id, r.severity) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
        scores.append((toxic, {(r.doc_id, round(r.score, 9)) for r in quality.quality(docs, labels).collect()}))
    assert scores[0] == scores[1]


def test_repeated_passages_are_the_same_each_time(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.choice(["ab" * 100, "cd" * 120, "ab" * 90 + "x" * 150])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, two = (sorted(map(tuple, suffix_dedup.repeated_passages(docs).collect())) for _ in range(2))
    assert one == two


def test_revisits_name_their_response():
    data = warc.record("revisit", "http://a.org/x", 9, "D", 5, b"", 3, "http://b.org/y")
    response = warc.record("response", "http://b.org/y", 3, "D", 5, b"hello")
    own = [line for line in response.decode().split("\r\n") if line.startswith("WARC-Record-ID: ")][0].removeprefix("WARC-Record-ID: ")
    assert f"WARC-Refers-To: {own}".encode() in data and b"WARC-Refers-To-Target-URI: http://b.org/y" in data
