"""The crawl as a stream against the crawl by rounds, its limits, and going on after a stop."""

import random

from pagewatch.operators import frontier
from pagewatch.streaming import crawling


def web(spark, n=40):
    rng = random.Random(4)
    links = [(i, rng.randrange(n)) for i in range(n) for _ in range(rng.choice([1, 2, 3]))]
    host = lambda i: f"h{i % 4}"
    rows = spark.createDataFrame([(f"u{a}", host(b), f"u{b}") for a, b in links] + [("u0", "h0", None)], "src string, to_host string, dst string").repartition(2)
    seeds = spark.createDataFrame([("h0", "u0"), ("h1", "u1"), ("h1", "u1"), ("h2", None)], "host string, url string")
    edges = spark.createDataFrame([(f"u{a}", f"u{b}") for a, b in links], "src string, dst string")
    return seeds, rows, {(r.node, r.hop) for r in frontier.crawl(seeds.where("url is not null").selectExpr("url node"), edges).collect()}


def test_stream_equals_rounds_and_goes_on(spark, tmp_path):
    seeds, links, want = web(spark)
    assert len(want) > 15
    folder = f"file://{tmp_path}/crawl"
    part = crawling.crawl(seeds, links, folder, most_runs=2).count()
    assert 0 < part < len(want)
    got = crawling.crawl(seeds.where("false"), links, folder).collect()  # begun before: goes on
    assert len(got) == len(want) and {(r.url, r.hop) for r in got} == want
    assert all(r.host == f"h{int(r.url[1:]) % 4}" for r in got)


def test_limits(spark, tmp_path):
    seeds, links, want = web(spark)
    got = crawling.crawl(seeds, links, f"file://{tmp_path}/turns", crawling.Limits(turn=2, pages=4)).collect()
    by_host = {}
    for r in got:
        by_host.setdefault(r.host, []).append(r.url)
    assert max(map(len, by_host.values())) == 4 and len(got) == len({r.url for r in got}) and {r.url for r in got} <= {u for u, _ in want}
    late = crawling.crawl(seeds, links, f"file://{tmp_path}/time", crawling.Limits(seconds=1)).collect()
    assert 0 < len(late) < len(want)
