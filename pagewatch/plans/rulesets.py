"""Queries of rule lists of real size, of links against requests, and of robots files over whole urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.functions import urls
from pagewatch.functions.robots import robots_rules
from pagewatch.operators import rules
from pagewatch.plans.catalogue import RULES, SQL_HOST, SQL_PATH, SQL_REQUESTED, _recorded, _sql_verdict, query, read
from pagewatch.sources import files

#: Rules of a large organisation: this many pairs, hosts and substrings, most of which no url has.
MANY = 100_000


def many_rules() -> dict:
    return {
        "link": [("example.net", f"/en/{i}") for i in range(0, MANY // 5, 7)], "white": [("example.com", f"/de/{i}.") for i in range(MANY // 5)] + [(f"x{i}.example.org", "/") for i in range(MANY // 5)],
        "deny": [f"d{i}.example.net" for i in range(MANY // 5)] + ["blog.tionsh.example.net"], "black": [f"/{i}.html" for i in range(MANY // 5, 2 * MANY // 5)] + ["/fr/1"],
        "allow": [f"a{i}.example.org" for i in range(MANY // 5)] + ["example.org", "example.net"],
    }


@query(f"""
WITH p AS MATERIALIZED (SELECT page_id, url, {SQL_HOST} AS host, {SQL_PATH} AS path, regexp_extract({SQL_PATH}, '^/en/([0-9]+)', 1) AS en, regexp_extract({SQL_PATH}, '^/de/([0-9]+)[.]', 1) AS de, regexp_extract({SQL_HOST}, 'x([0-9]+)[.]example[.]org$', 1) AS x,
    regexp_extract({SQL_HOST}, 'd([0-9]+)[.]example[.]net$', 1) AS d, list_transform(regexp_extract_all(url, '/([0-9]+)[.]html', 1), lambda n: n) AS b FROM pages),
s AS (SELECT page_id, list(i) FILTER (WHERE starts_with(path, '/en/' || i)) AS fits FROM p, range(0, {MANY // 5}, 7) AS r(i) WHERE en <> '' AND suffix(host, 'example.net') GROUP BY page_id)
SELECT p.page_id, CASE WHEN host = '' THEN 'EXTERNAL' WHEN fits IS NOT NULL THEN 'SPECIAL' WHEN suffix(host, 'example.com') AND de <> '' AND CAST(CAST(de AS HUGEINT) AS VARCHAR) = de AND CAST(de AS HUGEINT) < {MANY // 5} THEN 'ALLOW'
    WHEN x <> '' AND starts_with(path, '/') AND CAST(CAST(x AS HUGEINT) AS VARCHAR) = x AND CAST(x AS HUGEINT) < {MANY // 5} THEN 'ALLOW'
    WHEN suffix(host, 'blog.tionsh.example.net') OR d <> '' AND CAST(CAST(d AS HUGEINT) AS VARCHAR) = d AND CAST(d AS HUGEINT) < {MANY // 5} THEN 'EXTERNAL'
    WHEN contains(url, '/fr/1') OR len(list_filter(b, lambda n: CAST(CAST(n AS HUGEINT) AS VARCHAR) = n AND CAST(n AS HUGEINT) >= {MANY // 5} AND CAST(n AS HUGEINT) < {2 * MANY // 5})) > 0 THEN 'BLACK'
    WHEN suffix(host, 'example.org') OR suffix(host, 'example.net') THEN 'ALLOW' ELSE 'EXTERNAL' END AS verdict
FROM p LEFT JOIN s USING (page_id)""")
def url_verdict_many_rules(spark, sf_dir):
    """P1 with more than {MANY} rules; the SQL takes the numbers out of the urls instead."""
    return rules.with_verdict(read(spark, sf_dir, "pages").select("page_id", "url"), "url", many_rules()).select("page_id", "verdict")


@query(f"""
WITH r AS (SELECT page_id, {SQL_REQUESTED} AS url FROM pages)
SELECT page_id, url AS request, {_sql_verdict("url")} ELSE 'EXTERNAL' END AS as_link, {_sql_verdict("url", "request")} ELSE 'EXTERNAL' END AS as_request FROM r""")
def request_verdict(spark, sf_dir):
    """What browsers asked for, by the list for links and by that for requests."""
    recorded = _recorded(spark, sf_dir)
    asked = files.browser_record(recorded, F.col("html")).where("kind = 'Request'").select("page_id", F.col("value").alias("request"))
    as_link = rules.with_verdict(asked, "request", RULES, "as_link")
    return rules.with_verdict(as_link, "request", RULES, "as_request", special="request")


#: robots.txt of a host, by the length of its name modulo 6; a status over 0 stands for a file that isn't there.
ROBOTS_BY_HOST = [
    "User-agent: *\nDisallow: /*?sid=\n", "User-agent: *\nDisallow: /*/café\nAllow: /\n", "User-agent: page*tch\nAllow: /*.html?print\nDisallow: /*.html\n\nUser-agent: *\nDisallow: /\n",
    "403", "404", "User-agent: watch\nDisallow: /\n\nUser-agent: *\nDisallow: /*a*%2Fb\nDisallow: /*%23top\nDisallow: /~x:y\n",
]
#: Put behind a page's url; the first stands for the url without path.
TAILS = ["", "", "?sid=9", "?a=1&sid=2", "/café", "/caf%C3%A9/1", "/caf%c3%a9?x", ".html?print=1", "/a%2fxa/b", "/%zz+1", "#top", "?#", "/../~x:y"]


@query(f"""
WITH u AS (SELECT page_id, {SQL_HOST} AS host, i, CASE WHEN i = 1 THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) ELSE url || [{", ".join("'" + t + "'" for t in TAILS)}][i] END AS u FROM pages, range(1, {len(TAILS) + 1}) AS r(i)),
t AS (SELECT *, substr(u, strpos(u, '://') + 3 + len(host)) AS tail FROM u),
f AS (SELECT *, contains(tail, '.html') AS html, contains(tail, '?sid=') AS sid, regexp_matches(tail, '.+/caf(é|%[cC]3%[aA]9)') AS cafe, regexp_matches(tail, '[.]html[?]print') AS printed, regexp_matches(tail, 'a.*(/|%2f)b') AS ab FROM t)
SELECT page_id, u AS url, CASE len(host) % 6 WHEN 0 THEN NOT sid WHEN 1 THEN NOT cafe WHEN 2 THEN printed OR NOT html WHEN 3 THEN false WHEN 4 THEN true ELSE NOT (ab OR contains(tail, '#top')) END AS allowed FROM f""")
def robots_whole_urls(spark, sf_dir):
    """P8 of urls with queries, fragments, percent coding and without a path, for every host that pages have."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    said = F.element_at(F.array(*map(F.lit, ROBOTS_BY_HOST)), 1 + F.length("host") % len(ROBOTS_BY_HOST))
    found = pages.select("host").distinct().select("host", F.coalesce(said.try_cast("int"), F.lit(200)).alias("status"), said.alias("body"))
    tails = F.array(*(F.struct(F.lit(i == 0).alias("bare"), F.lit(t).alias("tail")) for i, t in enumerate(TAILS)))
    asked = pages.select("page_id", "url", F.inline(tails))
    bare = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1)
    asked = asked.select("page_id", F.when(F.col("bare"), bare).otherwise(F.concat("url", "tail")).alias("url"))
    return rules.with_can_fetch(asked, robots_rules(found), "pagewatch/1.0")
