import datetime
import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagewatch.functions import html, scan, scripts, urls
from pagewatch.functions.robots import robots_rules
from pagewatch.operators import frontier, history, reports, rules, terms
from pagewatch.plans import catalogue
from pagewatch.sources import files


def test_verdict_order(spark):
    own = {"link": [("s.x", "/p")], "request": [("q.y", "")], "white": [("x", "/w")], "deny": ["bad.x"], "black": ["evil"], "allow": ["x"], "ip": ["10."]}
    cases = [("nothing", None, "EXTERNAL"), ("http://s.x/p", None, "SPECIAL"), ("http://bad.x/w", None, "ALLOW"), ("http://bad.x/evil", None, "EXTERNAL"), ("http://a.x/evil", None, "BLACK"), ("http://a.x/", None, "ALLOW"), ("http://q.y/", None, "UNKNOWN"), ("http://q.y/", "10.1", "BLACK"), ("http://q.y/", "11.1", "EXTERNAL")]
    rows = spark.createDataFrame(cases, "url string, ip string, e string")
    assert rows.where(rules.verdict(F.col("url"), own, F.col("ip")) != F.col("e")).isEmpty()
    assert rules.with_verdict(rows, "url", own, address="ip").where("verdict <> e").isEmpty()
    asked = rules.with_verdict(rows, "url", own, special="request").collect()
    assert {r.url: r.verdict for r in asked if r.url in ("http://s.x/p", "http://q.y/")} == {"http://s.x/p": "ALLOW", "http://q.y/": "SPECIAL"}
    clash = rows.withColumns({"host": F.lit(1), "PATH": F.lit(2), "_host": F.lit(3)})
    assert rules.with_verdict(clash, "url", own).columns == [*clash.columns, "verdict"]


def test_long_rule_lists_give_what_short_ones_give(spark, monkeypatch):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("ab./") for _ in range(rng.randint(0, n)))
    rows = spark.createDataFrame([(f"http://{part(6)}/{part(6)}", part(4)) for _ in range(400)] + [("x", ""), ("", None), (None, None)], "url string, ip string")
    for _ in range(3):
        own = {k: [(part(3), "/" + part(3)) if k in ("link", "white") else part(4) + rng.choice("ab") for _ in range(n)] for k, n in (("link", 3), ("white", 4), ("deny", 5), ("black", 3), ("allow", 5), ("ip", 4))}
        short = rows.select("url", "ip", rules.verdict(F.col("url"), own, F.col("ip")).alias("v")).collect()
        monkeypatch.setattr(rules, "LISTED", 0)
        assert rows.select("url", "ip", rules.verdict(F.col("url"), own, F.col("ip")).alias("v")).collect() == short
        monkeypatch.undo()


def test_many_rules_are_planned(spark):
    own = {"white": [(f"h{i}.x", f"/{i}") for i in range(50_000)], "deny": [f"d{i}" for i in range(20_000)], "black": [f"b{i}b" for i in range(20_000)], "allow": [f"a{i}" for i in range(20_000)], "ip": [f"{i}." for i in range(300)]}
    cases = [("http://w.h49999.x/49999/y", None, "ALLOW"), ("http://h7.x/8", None, "UNKNOWN"), ("http://h7.x/8", "299.1", "BLACK"), ("http://h7.x/8", "300.1", "EXTERNAL"), ("http://x.d19999/", None, "EXTERNAL"), ("http://a3/b77b", None, "BLACK"), ("http://a3/b77", None, "ALLOW")]
    rows = spark.createDataFrame(cases, "url string, ip string, e string")
    assert rules.with_verdict(rows, "url", own, address="ip").where("NOT verdict <=> e").collect() == []
    longest = {"white": [("x", f"/{i}") for i in range(rules.LISTED)]}  # that is an expression
    assert rules.with_verdict(rows, "url", longest).count() == len(cases)
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    assert [r.url for r in rows.where(rules.any_pair(host, path, own["white"])).collect()] == ["http://w.h49999.x/49999/y"]


def test_rule_set_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([("DENY", str(i), None, None) for i in range(6)], "kind string, host_suffix string, path_prefix string, pattern string")
    monkeypatch.setattr(rules, "MOST_RULES", 6)
    assert len(rules.rule_set(rows)["deny"]) == 6
    monkeypatch.setattr(rules, "MOST_RULES", 5)
    with pytest.raises(ValueError, match="more than 5 rules"):
        rules.rule_set(rows)


@pytest.mark.parametrize(("line", "yes", "no"), [
    ("Disallow: /*?sid=", ["/a?sid=1", "/?x=1&a?sid=", "/%3Fsid=2"], ["/a?x=sid", "/sid=", ""]), ("Disallow: /café", ["/café", "/caf%C3%A9/x", "/caf%c3%a9"], ["/cafe", "/CAF%C3%89"]),
    ("Disallow: /", ["", "/", "?x", "#y", "/a"], []), ("Disallow: /a.b", ["/a.b", "/a.bc"], ["/aXb"]), ("Disallow: *b*d", ["/b/d", "/abcd"], ["/d/b", "/b"]), ("Disallow: /a%2fb", ["/a/b", "/a%2Fb"], ["/a"]),
    ("Disallow: /x%zz", ["/x%zz", "/x%25zz"], ["/x"]), ("Disallow: /a b+c", ["/a b+c", "/a%20b+c", "/a%20b%2Bc"], ["/a+b+c"]), ("Disallow: /$~:*", ["/$~:", "/%24~%3Ax"], ["/~"]), ("Disallow: /a?", ["/a", "/a?", "/ab"], ["/b"]),
])
def test_robots_lines(spark, line, yes, no):
    files_ = spark.createDataFrame([("h", 200, f"User-agent: *\n{line}\n")], "host string, status int, body string")
    rows = spark.createDataFrame([(f"http://h{u}", False) for u in yes] + [(f"http://h{u}", True) for u in no], "url string, lines boolean")
    assert rules.with_can_fetch(rows, robots_rules(files_), "bot").where("allowed <> lines").collect() == []


def test_robots_agents(spark):
    for agent, denied in (("pagewatch", True), ("Page", True), ("p*w*h", True), ("watch", False), ("pagewatch-news", False), ("p*z", False)):
        files_ = spark.createDataFrame([("h", 200, f"User-agent: {agent}\nDisallow: /\n"), ("gone", 403, None)], "host string, status int, body string")
        rows = spark.createDataFrame([("http://h/x",), ("http://gone",), (None,)], "url string")
        assert [r.allowed for r in rules.with_can_fetch(rows, robots_rules(files_), "PageWatch/2.0").orderBy("url").collect()] == [True, False, not denied]


def test_matches_boundary(spark):
    rows = spark.createDataFrame([("badexample.com", "/a"), ("x.example.com", "/a"), ("example.com", "/b"), ("", "")], "host string, path string")
    own = spark.createDataFrame([("example.com", "/a")], "host_suffix string, path_prefix string")
    assert {r.host for r in rules.matches(rows, own).collect()} == {"badexample.com", "x.example.com"}
    assert {r.host for r in rules.matches(rows, own, boundary=True).collect()} == {"x.example.com"}


def test_history(spark):
    d = datetime.date
    rows = spark.createDataFrame([("u", d(2024, 1, 1), "a"), ("u", d(2024, 1, 4), "a"), ("u", d(2024, 1, 5), "b"), ("u", d(2024, 1, 9), "b")], "url string, run_date date, hash string")
    assert [r.unchanged_days for r in history.unchanged_days(rows).orderBy("run_date").collect()] == [0, 3, 0, 4]
    now = spark.createDataFrame([("a", "1", 3), ("b", "2", 5), ("c", "3", 1), ("d", None, 0)], "url string, hash string, file_length long")
    old = spark.createDataFrame([("a", "1", 3), ("b", "9", 4)], "url string, hash string, file_length long")
    assert {r.url: (r.status, r.len_diff) for r in history.hash_status(now, old).collect()} == {"a": ("same", 0), "b": ("changed", 1), "c": ("new", None), "d": ("error", None)}
    assert history.new_values(now.select("url"), old.select("url").where("false")).isEmpty()
    assert {r.url for r in history.new_values(now.select("url"), old.select("url")).collect()} == {"c", "d"}


def test_contenders_have_the_top_terms(spark):
    rng = random.Random(4)
    rows = [("h", page, rng.choice("the of to in word longer wordier other".split() + [f"long{rng.randint(0, 40)}"])) for page in range(30) for _ in range(rng.choice([2, 10, 200]))]
    counted = terms.counts(spark.createDataFrame(rows, "host string, page int, word string"))
    near = [("h", 99, "the", 3_000_000), ("h", 99, "aword", 2_999_999), ("h", 99, "rare", 5)]  # the first two round alike
    counted = counted.unionByName(spark.createDataFrame(near, "host string, page int, word string, n long"))
    pages = terms.page_counts(counted)
    idf = terms.inverse_frequency(terms.document_frequency(counted), pages).where("length(word) > 3")
    for most in (1, 3, 10):
        first = terms.contenders(counted, F.length("word") <= 3, most)
        assert terms.page_counts(first).first() == pages.first()
        got = terms.top_terms(first.select("host", "page", "word", (F.col("n") / F.col("total")).alias("tf")), idf, pages, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, terms.top_terms(terms.term_frequency(counted), idf, pages, most).collect()))
    assert {r.word for r in terms.contenders(counted, F.length("word") <= 3, 1).where("page = 99").collect()} == {"the", "aword"}


def test_pages_with_words_from_their_texts(spark):
    some = ["", "1", "12 3", "a", "a b 9", "A.B", "1a", "a1", "é", "É 1", "ab", "٣", "1٣", "a-é", "aé", "ß", "--", "x 1 yz", None, "İ", "K", "中"]
    docs = spark.createDataFrame([(i, f"h{i}", t) for i, t in enumerate(some)] + [(1, "h20", "word"), (20, "h20", "again")], "doc_id int, source string, text string")
    assert sorted(map(tuple, terms.text_counts(docs).collect())) == sorted(map(tuple, terms.page_counts(terms.counts(terms.tokens(docs))).collect()))


def test_terms(spark):
    docs = spark.createDataFrame([(1, "h", "aa aa bb"), (2, "h", "bb cc"), (3, "h", "")], "doc_id long, source string, text string")
    counted = terms.counts(terms.tokens(docs))
    assert terms.page_counts(counted).first().n_pages == 2
    assert {r.word: r.df for r in terms.document_frequency(counted).collect()} == {"aa": 1, "bb": 2, "cc": 1}
    top = terms.top_terms(terms.term_frequency(counted), terms.inverse_frequency(terms.document_frequency(counted), terms.page_counts(counted)), terms.page_counts(counted), 1)
    assert {r.page: r.word for r in top.collect()} == {1: "aa", 2: "cc"}


def test_frontier(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.hop) for r in frontier.crawl(seeds, edges).collect()} == {(1, 0), (2, 1), (3, 2)}
    hosts = spark.createDataFrame([("a", 3), ("b", 0), ("c", 1), ("d", 9)], "host string, n long")
    assert [(r.host, r.turn) for r in frontier.schedule(hosts, 2).collect()] == [("c", "first"), ("d", "largest")]


def test_reports(spark):
    parts = spark.createDataFrame([(1, 10, 5, 100), (2, 20, 0, 200), (3, 30, 0, 300)], "part int, run_time long, remaining int, achieved long")
    assert tuple(reports.merge_runs(parts).first()) == (60, 200, 2)
    rows = spark.createDataFrame([("http://t.x/", "c"), ("http://u.x/", "d")], "url string, content string")
    assert {r.alert_type for r in reports.alerts(1, ["t.x"], k=rows).collect()} == {"k", "TEST_k"}


def test_settings_and_files(spark, tmp_path):
    lines = spark.createDataFrame([("MAX=2*3 # x",), ("MAX_process=-99",), ("odd=maybe",), ("on=True",), ("#a=1",)], "value string")
    assert {r.key: (r.number, r.problem) for r in files.settings(lines).collect()} == {"MAX": (6, False), "MAX_process": (1, False), "odd": (None, True), "on": (None, False)}
    (tmp_path / "WHITE.json").write_text('{"h.x": ["/a", "/b"]}')
    (tmp_path / "BLACK.json").write_text('["one", null, 3, "two", ["four"]]')
    (tmp_path / "ONLY.json").write_text("{")
    (tmp_path / "DOMAIN.json").write_text('{"allow": ["x.org"], "deny": ["y.org", "z.org"]}')
    found = files.rule_files(spark, [str(tmp_path / f"{n}.json") for n in ("WHITE", "BLACK", "ONLY", "DOMAIN")])
    assert sorted(r.kind for r in found.collect()) == ["ALLOW", "BLACK", "BLACK", "DENY", "DENY", "WHITE", "WHITE"]
    assert rules.rule_set(found) == {"only": [], "link": [], "request": [], "white": [("h.x", "/a"), ("h.x", "/b")], "deny": ["y.org", "z.org"], "black": ["one", "two"], "allow": ["x.org"], "ip": []}
    (tmp_path / "START_LIST.txt").write_text("http://a.x/\n\n  http://b.x/  \n")
    assert {tuple(r) for r in files.start_list(spark, str(tmp_path / "START_LIST.txt")).collect()} == {("http://a.x/", "START"), ("http://b.x/", "START")}
    for name, text in (("m1.csv", "Name,Template,Reference\na,text/a,r\nb,,r\n"), ("m2.csv", "Name,Template,Reference\na,text/a,r\nc,image/c,r\n")):
        (tmp_path / name).write_text(text)
    assert {r.mime for r in files.mime_types(spark, [str(tmp_path / "m1.csv"), str(tmp_path / "m2.csv")]).collect()} == {"text/a", "image/c"}
    csv = spark.createDataFrame([("a, b", 'say "x"')], "u string, v string")
    files.write_csv(csv, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect() == csv.collect()
    for kind in ("NORMAL", "ENCODE"):
        (tmp_path / "js" / kind).mkdir(parents=True)
        (tmp_path / "js" / kind / "a.js").write_text("var a = 1;\nx")
    texts = files.source_texts(spark, str(tmp_path / "js"))
    assert {(r.label, r.src_len, r.max_line) for r in scripts.with_features(texts, "text").collect()} == {("NORMAL", 12, 10), ("ENCODE", 12, 10)}
    files.write_csv(scripts.with_features(texts, "text").drop("text"), str(tmp_path / "features"))
    assert spark.read.option("header", True).csv(str(tmp_path / "features")).count() == 2
    assert files.newest_first(["/r/ROD_2", "/r/ROD_10", "/r/x", "/r/ROD_9"]) == ["/r/ROD_10", "/r/ROD_9", "/r/ROD_2", "/r/x"]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "nth int, v string")
    for nth in (1, 2):
        files.write_nth(rows, str(tmp_path / "w"), "t", nth)
    assert files.read_before(spark, str(tmp_path / "w"), "t", 2, "v string, nth int").count() == 2
    assert files.latest_good(spark, [str(tmp_path / "none"), str(tmp_path / "w/t/nth=1")]).count() == 2


def test_normalized_text(spark, tmp_path):
    found = ["caf\u00e9 e\u0301", "\uff21  b", "a\n\n\nb", " plain ", "x\ty", "\u3000\n\u00a0x", "", None]
    spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = {i: [y for x in unicodedata.normalize("NFKC", t or "").split("\n") if (y := " ".join(x.split()))] for i, t in enumerate(found)}
    got = {r.doc_id: r.hash for r in catalogue.QUERIES["normalized_text_all"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256("\n".join(own).encode()).hexdigest() for i, own in made.items()}
    assert {r.doc_id: r.n_lines for r in catalogue.QUERIES["normalized_text"](spark, str(tmp_path)).collect()} == {i: len(own) for i, own in made.items()}


def test_body_scan(spark, tmp_path):
    found = ["x" * 20_000 + "###", "x" * 30_000 + "!!", "a!!", "none", None]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.signature for r in catalogue.QUERIES["body_scan"](spark, str(tmp_path)).collect()}
    assert got == {0: "hash-marks", 1: "shouting", 2: "shouting", 3: None, 4: None}
    gated = docs.where("text is not null").select("doc_id", scan.scan(F.col("text"), {"shouting": "!!"}, 4).alias("s"))
    assert {r.doc_id: r.s for r in gated.collect()} == {0: None, 1: None, 2: "shouting", 3: None}


def test_hosts_entry(spark):
    names = "host string, entry_no int, agent string, rule_no int, path_pattern string, allow boolean, delay int, rate_requests int, rate_seconds int"
    own = [("h", 0, "*", 0, "/", False, 3, None, None), ("h", 1, "page", 0, "/a", False, 7, 1, 2), ("h", 1, "page", 1, "/a/b", True, 7, 1, 2), ("h", 2, "pagewatch", 0, "/", False, 9, None, None)]
    table = spark.createDataFrame(own, names)
    pages = spark.createDataFrame([(1, "http://h/a/b"), (1, "http://h/x"), (None, "http://h/a"), (2, "http://i/a"), (3, None)], "page_id long, url string")
    got = sorted(((r.page_id, r.allowed) for r in rules.can_fetch(pages, table, "PageWatch/2").collect()), key=repr)
    assert got == sorted([(1, False), (1, True), (None, False), (2, True), (3, True)], key=repr)
    assert [tuple(r) for r in rules.crawl_waits(spark.createDataFrame([("h",), ("i",)], "host string"), table, "pagewatch").orderBy("host").collect()] == [("h", 7, 1, 2), ("i", None, None, None)]


def test_merge_filters(spark):
    old = spark.createDataFrame([("a", "/x"), ("b", "")], "host string, prefix string")
    new = spark.createDataFrame([("a", ""), ("a", "/z"), ("b", "/y"), ("c", ""), ("c", "/q")], "host string, prefix string")
    assert {r.host: r.prefixes for r in history.merge_filters(old, new).collect()} == {"a": "/x", "b": " /y", "c": " /q"}


def test_links_of_feeds(spark):
    feed = '<rss><link>http://a.x/1</link><item><link> <![CDATA[http://a.x/2]]> </link></item><link href="http://a.x/3" rel="self"/><link></link></rss>'
    assert spark.createDataFrame([(feed,)], "x string").select(html.xml_links(F.col("x"))).first()[0] == ["http://a.x/1", "http://a.x/2", "http://a.x/3"]


def test_fetched(spark):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(3)
            self.send_response({"/moved": 302, "/gone": 404}.get(self.path, 200))
            if self.path == "/moved":
                self.send_header("Location", "/page")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<p>hello</p>")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        found = {r.url: r for r in files.fetched(spark.createDataFrame([(f"{root}/{p}",) for p in ("page", "moved", "gone")], "url string").coalesce(1)).collect()}
        assert found[f"{root}/page"].content_type == "text/html; charset=utf-8" and bytes(found[f"{root}/page"].body) == b"<p>hello</p>"
        assert found[f"{root}/moved"].final_url == f"{root}/page" and found[f"{root}/gone"].status == 404 and found[f"{root}/gone"].body is None
        assert "timed out" in files.http_get(f"{root}/slow", 0.3)["error"]
        assert files.http_get("no url")["error"]
    finally:
        server.shutdown()


def test_normal_urls_keep_their_helper_columns_apart(spark):
    rows = spark.createDataFrame([("a/../b", "http://h/x/y")], "link string, page string")
    assert urls.with_normal(rows, "link", "page", "url").first().url == "http://h/x/b"
