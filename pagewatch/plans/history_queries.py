"""Queries of what pages were before: placement of elements, and changes beyond the hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.functions import text, urls
from pagewatch.operators import changes, history, placement
from pagewatch.plans.catalogue import SQL_CRAWL, query, read
from pagewatch.sources import commits
from pagewatch.sources.folders import new_folder, table
from pagewatch.streaming import crawling

#: What stands before the first tag of that kind in a page, by page_id modulo 5; the others stay as they are.
PLACED = [("<p>", '<iframe src="/ad" width="300" height="200"></iframe>'), ("</body>", '<iframe src="http://x.example.edu/" width="0" height="0"></iframe>')]


def _placed_pages(spark, sf_dir):
    """host, html of all pages, of which some have an iframe among their own markup, and others an invisible one."""
    html = F.col("html")
    for i, (where, iframe) in enumerate(PLACED):
        at = F.instr("html", where)
        html = F.when((F.col("page_id") % 5 == i) & (at > 0), F.concat(F.substring("html", F.lit(1), at - 1), F.lit(iframe), F.substring("html", at, F.length("html")))).otherwise(html)
    return read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), html.alias("html"))


@query()
def placement_trees(spark, sf_dir):
    """The splits of every host's tree over the tags of its pages."""
    found = placement.elements(_placed_pages(spark, sf_dir), "host", "html")
    return placement.train(found).withColumn("gain", F.round("gain", 6))


#: States of three runs and more, with gaps: each is missing at some dates.
SQL_STATES = """s AS (SELECT user_id, CAST(ts AS DATE) AS run_date, max(event_type) FILTER (WHERE event_id % 3 <> 0) AS hash, CAST(max(event_id) FILTER (WHERE event_id % 4 = 0) AS BIGINT) AS file_length,
    min(props) FILTER (WHERE event_id % 5 = 1) AS words FROM events GROUP BY ALL)"""


def _states(spark, sf_dir):
    n = F.col("event_id")
    states = {"hash": F.max(F.when(n % 3 != 0, F.col("event_type"))), "file_length": F.max(F.when(n % 4 == 0, n)), "words": F.min(F.when(n % 5 == 1, F.col("props")))}
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url"), F.to_date("ts").alias("run_date")).agg(*(v.alias(k) for k, v in states.items()))


@query(f"""
WITH {SQL_STATES}
SELECT s.user_id, strftime(s.run_date, '%Y-%m-%d') AS run_date, h.hash AS before_hash, l.file_length AS before_file_length, w.words AS before_words,
    CASE WHEN s.hash IS NULL THEN 'error' WHEN h.hash IS NULL THEN 'new' WHEN s.hash = h.hash THEN 'same' ELSE 'changed' END AS status
FROM s ASOF LEFT JOIN (SELECT * FROM s WHERE hash IS NOT NULL) h ON s.user_id = h.user_id AND s.run_date > h.run_date
ASOF LEFT JOIN (SELECT * FROM s WHERE file_length IS NOT NULL) l ON s.user_id = l.user_id AND s.run_date > l.run_date
ASOF LEFT JOIN (SELECT * FROM s WHERE words IS NOT NULL) w ON s.user_id = w.user_id AND s.run_date > w.run_date""")
def state_as_of(spark, sf_dir):
    """Of every url and run the latest earlier hash, length and words, each from the run that last had it."""
    states = _states(spark, sf_dir)
    found = changes.as_of(states, states, ["hash", "file_length", "words"]).withColumn("status", changes.status(F.col("hash"), F.col("before_hash")))
    return found.select(F.col("url").alias("user_id"), F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "before_hash", "before_file_length", "before_words", "status")


def _runs(spark, sf_dir):
    """html of pages now, and of two runs before it: the first lacks some pages, the second others, and most have another line."""
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first = pages.where("page_id % 4 <> 1").select(F.col("page_id").alias("url"), day(0).alias("run_date"), F.replace("html", F.lit("<p>"), F.lit("\n<p>")).alias("html"))
    second = pages.where("page_id % 3 = 0").select(F.col("page_id").alias("url"), day(1).alias("run_date"), F.replace(F.replace("html", F.lit("</ul>"), F.lit("</ul>\nonce\n")), F.lit("<p>"), F.lit("\n<p>")).alias("html"))
    now = pages.select(F.col("page_id").alias("url"), day(2).alias("run_date"), F.when(F.col("page_id") % 7 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<p>"), F.lit("\n<p>"))).alias("html"))
    return now, first.unionByName(second)


SQL_RUNS = r"""f AS (SELECT page_id, html, replace(html, '<p>', chr(10) || '<p>') AS lined FROM pages),
r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN html ELSE lined END AS html, CASE WHEN page_id % 3 = 0 THEN replace(replace(html, '</ul>', '</ul>' || chr(10) || 'once' || chr(10)), '<p>', chr(10) || '<p>') WHEN page_id % 4 <> 1 THEN lined END AS before FROM f)"""


@query(f"WITH {SQL_RUNS} SELECT page_id, len(before) AS old_length, len(html) AS new_length FROM r WHERE before IS NOT NULL AND before <> html")
def page_changed_html(spark, sf_dir):
    """F36 against the latest of two earlier runs: which pages' markup changed, and how long it was and is."""
    now, history = _runs(spark, sf_dir)
    found = changes.changed_lines(changes.as_of(now, history, ["html"]), "html", "before_html")
    return found.select(F.col("url").alias("page_id"), "old_length", "new_length")


@query(f"""
WITH {SQL_RUNS}, a AS (SELECT page_id, html, before, len(before) - len(replace(before, '</ul>' || chr(10) || 'once' || chr(10), '')) AS more FROM r WHERE before IS NOT NULL AND before <> html AND page_id % 7 <> 0)
SELECT page_id, 'once' AS gone FROM a WHERE more > 0""")
def page_lines_gone(spark, sf_dir):
    """pages of which a line `once` is gone since the latest earlier run, though no line around it changed."""
    now, history = _runs(spark, sf_dir)
    found = changes.changed_lines(changes.as_of(now.where("url % 7 <> 0"), history, ["html"]), "html", "before_html")
    lines = found.select(F.col("url").alias("page_id"), F.explode("changes").alias("c")).select("page_id", F.explode("c.old").alias("gone"))
    return lines.where("gone = 'once'").distinct()


def _signatures(spark, sf_dir):
    now, history = _runs(spark, sf_dir)
    hashed = lambda rows: rows.select("url", "run_date", text.fuzzy_hash(F.col("html")).alias("signature"))
    return table(hashed(now), "signatures"), table(hashed(history), "signatures")


@query()
def page_sshash_change(spark, sf_dir):
    """F27 against history: of each page how alike it is to what it was when its fuzzy hash was last taken; null if it never was."""
    found = changes.as_of(*_signatures(spark, sf_dir), ["signature"])
    return found.select(F.col("url").alias("page_id"), "signature", "before_signature", text.fuzzy_score(F.col("signature"), F.col("before_signature")).alias("score"))


@query()
def page_sshash_alike(spark, sf_dir):
    """F27 over all pages: the pairs of a fuzzy hash now and one before with a score of 60 or more, whatever their urls."""
    return changes.alike(*_signatures(spark, sf_dir), 60)


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS body FROM pages), n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id) - 1 AS pos, body FROM t)
SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN page_id % 4 = 1 THEN 'new' WHEN page_id % 6 = 0 THEN 'changed' ELSE 'same' END AS status FROM n""")
def js_hash_status(spark, sf_dir):
    """The scripts of every page by their hashes, against an earlier run: changed, same or new."""

    def run(pages, day):
        bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script>(.*?)</script\s*>"), F.lit(1))
        rows = pages.select("page_id", F.posexplode(bodies).alias("pos", "body"))
        return rows.select("page_id", "pos", F.concat_ws(" ", "page_id", "pos").alias("url"), F.lit(day).cast("date").alias("run_date"), history.body_hash(F.col("body")).alias("hash"))

    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    old = pages.where("page_id % 4 <> 1").withColumn("html", F.when(F.col("page_id") % 6 == 0, F.replace("html", F.lit("</script>"), F.lit(";x()</script>"))).otherwise(F.col("html")))
    found = changes.as_of(run(pages, "2024-01-02"), run(old, "2024-01-01"), ["hash"])
    return found.select("page_id", "pos", changes.status(F.col("hash"), F.col("before_hash")).alias("status"))


@query(f"WITH RECURSIVE {SQL_CRAWL} SELECT node, min(hop) AS hop FROM r GROUP BY node")
def crawl_stateful(spark, sf_dir):
    """ST1 over the links of crawl_frontier: ten hosts, each with its own queue, run after run until nothing is found."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    n = pages.agg((F.max("page_id") + 1).alias("n"), F.min("page_id").alias("node"))
    sized = pages.join(F.broadcast(n.select("n")), F.col("page_id") < F.col("n"))  # one row
    links = sized.select(F.col("page_id").alias("src"), F.explode(F.array((F.col("page_id") * 2 + 1) % F.col("n"), F.col("page_id") * 3 % F.col("n"))).alias("dst"))
    named = links.select(F.col("src").cast("string").alias("src"), (F.col("dst") % 10).cast("string").alias("to_host"), F.col("dst").cast("string").alias("dst"))
    seeds = n.select((F.col("node") % 10).cast("string").alias("host"), F.col("node").cast("string").alias("url"))
    found = crawling.crawl(seeds, table(named, "links"), new_folder(spark, "crawl"))
    return found.select(F.col("url").cast("long").alias("node"), "hop")


@query("SELECT page_id, 2 AS version, sha256(html) AS hash FROM pages")
def state_committed(spark, sf_dir):
    """Two states of all pages are published, a third is torn; read is the second."""
    pages = read(spark, sf_dir, "pages").select("page_id", history.body_hash(F.col("html")).alias("hash"))
    state = commits.Versions(spark, new_folder(spark, "versions"))
    state.publish(pages.withColumn("hash", F.lit("old")))
    state.publish(pages)
    torn = state.publish(pages.withColumn("hash", F.lit("torn")))
    state.damage(torn)
    number, found = state.newest()
    return found.select("page_id", F.lit(number).alias("version"), "hash")
