import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewatch.functions import html, scripts, text, urls
from pagewatch.functions.robots import parse


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "given_url", "expected"),
    [
        (urls.remove_query, "http://www.a.ac.jp/js/m.min.js/?&version=", "http://www.a.ac.jp/js/m.min.js"),
        (urls.remove_query, "http://www.google.com/url?sa=p&q=x", "http://www.google.com/url"),
        (urls.remove_query, "http://a.b/c", "http://a.b/c"),
        (urls.remove_scheme, "https://a.b/c", "a.b/c"),
        (urls.remove_scheme, "a.b/c", "a.b/c"),
        (urls.remove_port, "http://localhost:8000", "http://localhost"),
        (urls.remove_port, "host:443/p", "host/p"),
        (urls.request_url, "http://www.google.com/url?sa=p&q=http://a.b/c?d=e", "a.b/c"),
        (urls.host, "http://user@h.x:81/p", "user@h.x:81"),
        (urls.host, "no url", ""),
        (urls.host_file, "a.b:80", "a-b-80"),
        (urls.resolve_dots, "/a/b/../c/../../d", "/d"),
        (urls.resolve_dots, "/../../a/", "/a/"),
        (urls.leading_int, "12px", 12),
        (urls.leading_int, "", 0),
    ],
)
def test_url(spark, function, given_url, expected):
    assert one(spark, function(F.col("u")), u=given_url) == expected


@pytest.mark.parametrize(
    ("src", "page", "expected"),
    [
        ("http://h.x/s.jsp?a=1&amp;b=2", "http://h.x/i/", "http://h.x/s.jsp?a=1&b=2"),
        ("//h.y/x.js", "https://h.x/i/", "https://h.y/x.js"),
        ("/script.jsp?id=1", "http://h.x/a/b/", "http://h.x/script.jsp?id=1"),
        ("../js/script.js", "http://h.x/a/b/", "http://h.x/a/js/script.js"),
        ("../../../../js/script.js", "http://h.x/a/b/c/d/", "http://h.x/js/script.js"),
        ("js/x.js", "http://h.x/a/page.html", "http://h.x/a/js/x.js"),
        ("js/x.js", "http://h.x", "http://h.x/js/x.js"),
    ],
)
def test_script_url(spark, src, page, expected):
    assert one(spark, urls.script_url(F.col("s"), F.col("p")), s=src, p=page) == expected


def test_normal_links(spark):
    rows = spark.createDataFrame([("a/../b?x=1&y=2#f", "http://h.x/d/p.html"), ("b?x", "http://h.x"), ("?q=1", "http://h.x/p")], "l string, p string")
    assert [r.n for r in urls.with_normal(rows, "l", "p", "n").collect()] == ["http://h.x/d/b?x=1&y=2", "http://h.x/b", "http://h.x/p?q=1"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("aAzZgG12:;", {"numbers": 2, "alphabets": 6, "symbols": 2}),
        ("<!-- Time: 1.08054 Sec. -->", {"numbers": 6, "alphabets": 7, "symbols": 10}),
        ("", {"src_len": 0, "alphabets_per": 0.0, "blank_per": 1.0, "max_line": 0, "chars_over_words": False}),
    ],
)
def test_script_features(spark, source, expected):
    row = scripts.with_features(spark.createDataFrame([(source,)], "s string"), "s").first()
    assert {k: row[k] for k in expected} == expected


def test_script_verdict(spark):
    cases = [(52, 8, 0, "NORMAL"), (500, 3, 0, "RANDOM1"), (1999, 1, 2, "RANDOM2"), (500, 0, 0, "ENCODE5"), (2000, 201, 0, "ENCODE6"), (2000, 100, 0, "RANDOM3"), (2000, 3, 1, "ENCODE7"), (2000, 0, 0, "RANDOM4")]
    rows = spark.createDataFrame(cases, "l int, c int, w int, v string")
    assert rows.where(scripts.verdict(F.col("l"), F.col("c"), F.col("w")) != F.col("v")).isEmpty()


def test_iframes(spark):
    tags = [('<iframe src="x" width="0%" height="0%">', True), ('<iframe src="x" width="10%" height="10%">', False), ('<iframe src="x">', True), ('<iframe width="1" height="1" style="width:9px">', False), ('<iframe width="" height="" style="width:0px">', True)]
    rows = spark.createDataFrame(tags, "t string, e boolean")
    assert rows.where(html.invisible_iframe(F.col("t")) != F.col("e")).isEmpty()


def test_refresh_and_parser(spark):
    page = '<META http-equiv=REFRESH content="0; url=./re_2.html"><fORm acTIon=/go><a href=x>'
    assert one(spark, html.refresh_target(F.col("h")), h=page) == "./re_2.html"
    rows = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    found = {(r.tag, r.name, r.value) for r in html.parsed_attributes(rows).collect()}
    assert {("form", "action", "/go"), ("a", "href", "x")} <= found


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        (["a", "1", "121", "c"], ["a", "1", "222", "c"], [("modified", ["121"], ["222"])]),
        (["a", "1", "121", "c"], ["a", "1", "c"], [("delete", ["121"], [])]),
        (["a"], ["a", "b"], [("add", [], ["b"])]),
        (["a"], [], [("delete", ["a"], [])]),
        (["x", "k"], ["y", "z", "k"], [("modified", ["x"], ["y"]), ("add", [], ["z"])]),
    ],
)
def test_line_changes(old, new, expected):
    assert text.line_changes(old, new) == expected


def test_trimmed():
    assert text.line_changes(["id=12 end"], ["id=345 end"], trim=True) == [("modified", ["12"], ["345"])]


@given(st.binary(max_size=600), st.binary(max_size=40))
@settings(max_examples=25, deadline=None)
def test_fuzzy(data, more):
    own = text.fuzzy_hash_of(data)
    assert text.fuzzy_score_of(own, own) == 100
    assert 0 <= text.fuzzy_score_of(own, text.fuzzy_hash_of(data + more)) <= 100


def test_fuzzy_near_and_far():
    import random

    rng = random.Random(4)
    data = bytes(rng.choice(b"abcdefghij klm") for _ in range(4000))
    other = bytes(rng.choice(b"nopqrstuvwxyz") for _ in range(4000))
    assert text.fuzzy_score_of(text.fuzzy_hash_of(data), text.fuzzy_hash_of(data[:2000] + b"!!" + data[2000:])) > 60
    assert text.fuzzy_score_of(text.fuzzy_hash_of(data), text.fuzzy_hash_of(other)) == 0


def test_fuzzy_vectors():
    """Published examples of the hash."""
    one, two = (b"Also called fuzzy hashes, %s can match inputs that have homologies." % w for w in (b"Ctph", b"CTPH"))
    assert text.fuzzy_hash_of(one) == "3:AXGBicFlgVNhBGcL6wCrFQEv:AXGHsNhxLsr2C"
    assert text.fuzzy_hash_of(two) == "3:AXGBicFlIHBGcL6wCrFQEv:AXGH6xLsr2C"
    assert text.fuzzy_score_of(text.fuzzy_hash_of(one), text.fuzzy_hash_of(two)) == 22


def scalar_signature(data, size):
    """The hash byte by byte, as it is defined."""
    window, h1, h2, h3, n = [0] * 7, 0, 0, 0, 0
    out, fnv = [[], []], [0x28021967] * 2
    for byte in data:
        h2 += 7 * byte - h1
        h1 += byte - window[n % 7]
        window[n % 7], n = byte, n + 1
        h3 = (h3 << 5 ^ byte) & 0xFFFFFFFF
        fnv = [(f * 0x01000193 & 0xFFFFFFFF) ^ byte for f in fnv]
        for i, most in enumerate((63, 31)):
            own = size << i
            if (h1 + h2 + h3 & 0xFFFFFFFF) % own == own - 1 and len(out[i]) < most:
                out[i].append(fnv[i] & 63)
                fnv[i] = 0x28021967
    return ["".join(text._BASE64[x] for x in [*o, f & 63]) for o, f in zip(out, fnv, strict=True)]


@given(st.lists(st.binary(max_size=900), max_size=6))
@settings(max_examples=40, deadline=None)
def test_fuzzy_hashes_byte_by_byte(found):
    for data, got in zip(found, text.fuzzy_hashes(found), strict=True):
        size, one, two = got.split(":")
        assert [one, two] == scalar_signature(data, int(size))


def test_text(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="Ａ  b \n\n ｃ\t d ") == "A b\nc d"
    for said, level in (("Hacked by x", 3), ("ha cked", 2), ("HACK", 1), ("", 0)):
        assert one(spark, text.hack_level(F.col("t")), t=said) == level
    assert one(spark, text.words(F.col("t")), t="Ab 12 x é 3d") == ["ab", "é", "3d"]


def test_robots():
    assert parse("", 403) == [(0, "*", 0, "/", False, None, None, None)]
    assert parse("User-agent: *\nDisallow: /", 404) == []
    got = parse("Disallow: /early\nUser-agent: a\nUser-agent: B\nDisallow:\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /x # y\nUser-agent: *\nDisallow: /z")
    assert got == [(0, "a", 0, "/", True, 2, None, None), (0, "b", 0, "/", True, 2, None, None), (1, "*", 0, "/x", False, None, None, None)]
    assert parse("User-agent: a\n\nUser-agent: b\nDisallow: /x") == [(0, "b", 0, "/x", False, None, None, None)]  # an empty line drops agents without lines
    assert parse("User-agent: a\n# said\nUser-agent: *\nDisallow: /x\nUser-agent: last") == [(0, "*", 0, "/x", False, None, None, None)]  # * takes its entry
    assert parse("User-agent: a\nCrawl-delay: 4\nDisallow: /y\n\nDisallow: /z") == [(0, "a", 0, "/y", False, 4, None, None)]


MARKUP = [
    "<a href='q'>", "<a href=q>", '<a data-src="lazy.js" href = "x.js">', '<script data-src="lazy.js" src="true.js"></script>', '<!-- <a href="no"> --><a href="yes">', '<script>"<a href=no>"</script><a href=yes>',
    "<script>a<!--b</script><a href='after'>", '<A\nHREF="u">', '<a title="x > y" href="z">', '<a title="href=\'no\'" href=yes>', "<abbr href=no><a href=yes/>", '<a href="a" href="b">', "<a href>", "<a href=''>", '<a hreflang="no" href="é&amp;1">',
    '<iframe src="a" width=1 style="b:c"></iframe>', '<style>a{content:"<a href=no>"}</style><form action=/go method=post>', "<a class='x'href='tight'>", "a < b <a href=ok>", "<a href=one two=three>", "<a / href=slash>",
]


@pytest.mark.parametrize("page", MARKUP)
def test_attributes_are_those_of_a_parser(spark, page):
    import html as entities

    rows = spark.createDataFrame([(1, page)], "page_id long, html string")
    parsed = html.parsed_attributes(rows).collect()
    for tag, name in (("a", "href"), ("script", "src"), ("iframe", "src"), ("iframe", "style"), ("form", "action")):
        first = {}
        for r in parsed:
            if (r.tag, r.name) == (tag, name):
                first.setdefault(r.element, r.value)
        got = [entities.unescape(v) for v in one(spark, html.attributes(F.col("h"), tag, name), h=page)]
        assert [v for v in got if v] == [v for v in first.values() if v], (tag, name)


def test_long_markup(spark):
    """Some MB of markup with a tag of thousands of attributes."""
    wide = "<a " + " ".join(f'data-x{i}="v > {i}"' for i in range(5000)) + " href='deep'>"
    page = "<p>text</p>" * 200_000 + wide + "<script>" + "x < y; " * 100_000 + "</script><a href=end>"
    assert one(spark, html.attributes(F.col("h"), "a", "href"), h=page) == ["deep", "end"]


PIECES = [
    "<a", "<A", "<script", "</script>", "</script >", "<style>", "</style>", "</a>", "</a", "<b>", "<br/>", "<!--", "-->", "-- >", "<!-->", "<!doctype html>", "<?x", "<![CDATA[", "]]>", "<title>", "</title>", "<", ">", " >", "/>",
    " href=", " HREF = ", "\nhref\t=\n", " title=", " src=", " x", " data-href=", " href", "=", "==", "/", '"', "'", "it's", '5"', '"/q"', "'/s'", "/bare/", '"a > b"', "'<a href=/in>'", " ", "\n", "text", "&", "éü", "<a href=/plain>", "<script>x='<a href=/no>';", "<a title=it's href=/it>",
]


class Parser(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.found, self.said = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, attrs))

    def first(self, tag, name):
        values = [next((v for k, v in attrs if k == name and v is not None), None) for t, attrs in self.found if t == tag]
        return [v for v in values if v]


def broken_pages(n):
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_tokeniser_sees_what_a_parser_sees(spark):
    pages = broken_pages(6000)
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    found = rows.select("i", html.tag_names(F.col("h")).alias("names"), html.attributes(F.col("h"), "a", "href").alias("links"), html.attributes(F.col("h"), "script", "src").alias("scripts")).collect()
    several = 0
    for r in found:
        seen = Parser(pages[r.i])
        assert r.names == [t for t, _ in seen.found], pages[r.i]
        assert [v for v in r.links if v] == seen.first("a", "href"), pages[r.i]
        assert [v for v in r.scripts if v] == seen.first("script", "src"), pages[r.i]
        several += len(r.links) > 1
    assert several > 300


def test_long_markup_needs_no_stack(spark):
    page = "<a " + "x=1 " * 200_000 + "href=/end>" + "<b '\"" * 50_000 + "<!--" + "-" * 200_000 + "--><script>" + "<" * 200_000 + "</script><a href=/last>"
    assert one(spark, html.attributes(F.col("h"), "a", "href"), h=page) == ["/end", "/last"]
    assert one(spark, F.length(html.visible_text(F.col("h"))), h=page) is not None


@pytest.mark.parametrize(("page", "text"), [
    ('<p title="a > b">x</p>y', "x y"), ("a<!-- <p> --> b", "a b"), ("<title>t</title><script>if (a<b) x('</p>')</script>z<style>p{}</style>", "z"), ("5 < 6 <b>7</b>", "5 < 6 7"), ('<a href="x>open', '<a href="x> open'), ("<script>never closed", ""), (None, None), ("", ""),
])
def test_visible_text(spark, page, text):
    assert one(spark, html.visible_text(F.col("h")), h=page) == text


def test_rewrite_leaves_what_is_no_script(spark):
    page = "<!-- <script src=c.js> --><script>x='<script src=s.js>'</script><p title='<script src=q.js>'></p><script src=r.js></script>"
    want = page.replace("src=r.js", 'src="http://h/d/r.js"')
    assert one(spark, html.rewrite_scripts(F.col("h"), F.lit("http://h/d/p.html")), h=page) == want
