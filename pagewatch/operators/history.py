"""Snapshots against history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.sources.folders import table


def body_hash(body: Column) -> Column:
    """null for an empty body."""
    return F.when(F.length(body) > 0, F.sha2(body, 256))


def hash_status(current: DataFrame, previous: DataFrame, key: str = "url") -> DataFrame:
    """J4, ST2: key, status (new, same, changed, error), len_diff per row of current. Both sides: key, hash, file_length.

    Of several rows of a key in previous that with the latest run_date counts, if there is such a column, then that of the
    largest hash. changes.as_of() looks states up that are missing in some runs.
    """
    when = F.col("run_date") if "run_date" in previous.columns else F.lit(None).cast("date")
    last = F.max(F.struct(when.alias("run_date"), F.col("hash").alias("old_hash"), F.col("file_length").alias("old_length"))).alias("last")
    before = previous.groupBy(key).agg(last).select(key, "last.old_hash", "last.old_length", F.lit(True).alias("seen"))
    status = F.when(F.col("hash").isNull(), "error").when(F.col("seen").isNull(), "new").when(F.col("hash") == F.col("old_hash"), "same").otherwise("changed")
    return current.join(before, key, "left").select(key, status.alias("status"), (F.col("file_length") - F.col("old_length")).alias("len_diff"))


def unchanged_days(states: DataFrame) -> DataFrame:
    """Url, run_date, hash, changed, unchanged_days; states: url, run_date, hash (one row a url and date)."""
    order = Window.partitionBy("url").orderBy("run_date")
    changed = F.coalesce((F.lag("hash").over(order) != F.col("hash")).cast("int"), F.lit(1))
    marked = states.withColumn("changed", changed).withColumn("island", F.sum("changed").over(order))
    since = F.min("run_date").over(Window.partitionBy("url", "island"))
    return marked.select("url", "run_date", "hash", "changed", F.datediff("run_date", since).alias("unchanged_days"))


def new_values(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of current that previous lacks; none where there is no history at all."""
    history = previous.limit(1).select(F.lit(1).alias("_history")).distinct()
    return current.distinct().join(previous.distinct(), current.columns, "left_anti").join(F.broadcast(history), F.lit(True), "left_semi")


def compare_sets(html: DataFrame, requested: DataFrame, on: list[str]) -> DataFrame:
    """On, side (html or request) of what only one side has; browser built-ins (P21) don't count."""
    requested = requested.where(~F.col(on[-1]).startswith("chrome"))
    only_request = requested.distinct().join(html, on, "left_anti").withColumn("side", F.lit("request"))
    return html.distinct().join(requested, on, "left_anti").withColumn("side", F.lit("html")).unionByName(only_request)


def distinct_contents(files: DataFrame, body: str, order: str) -> DataFrame:
    """Of equal bodies the first by order: order, sha256, copies."""
    rows = files.select(order, F.sha2(body, 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def url_sets(parts: list[DataFrame], test_hosts: list[str]) -> DataFrame:
    """Host, url: the union of all parts' urls (host, url), test hosts left out."""
    every = reduce(DataFrame.unionByName, [p.select("host", "url") for p in parts])
    return every.where(~F.col("host").isin(*test_hosts) if test_hosts else F.lit(True)).distinct()


def filters_of(urls_: DataFrame) -> DataFrame:
    """Host, prefix (empty: any path) of each host that alerts name; urls_: host."""
    return urls_.where("host <> ''").select("host", F.lit("").alias("prefix")).distinct()


def merge_filters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Host, prefixes (sorted, distinct), joined by blanks; both sides: host, prefix.

    A host that only new has comes with all its prefixes. One that old has too gets new's prefixes unless the first of these is empty.
    """
    first = new.groupBy("host").agg(F.min("prefix").alias("least"))
    known = old.select("host").distinct().withColumn("known", F.lit(True))
    added = new.join(first, "host").join(known, "host", "left").where("known is null OR least <> ''").select("host", "prefix")
    both = old.select("host", "prefix").unionByName(added)
    return both.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("prefix")), " ").alias("prefixes"))


def stringified(values: Column) -> Column:
    """a set as text: sorted, distinct, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ", ")


def rename_host(rows: DataFrame, old: str, new: str) -> DataFrame:
    """J14."""
    return rows.withColumn("url", F.replace("url", F.lit(old), F.lit(new)))


def numbered(values: DataFrame, name: str) -> DataFrame:
    """The distinct values of a column, and code: how many come before each. Sorted by ranges; the driver gets a number a range."""
    sorted_ = values.select(name).distinct().repartitionByRange(name).sortWithinPartitions(name)
    rows = table(sorted_.select(name, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "numbered")
    before, sizes = 0, {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    own = values.sparkSession.createDataFrame(starts, "part int, start long")
    return rows.join(F.broadcast(own), "part").select(name, (F.col("start") + F.col("at")).alias("code"))  # a row a range


def tag_codes(pages: DataFrame) -> DataFrame:
    """Host, n_pages, codes: the numbers (by name) of the tags that a host's pages have; pages: host, page, tag."""
    out = pages.join(numbered(pages, "tag"), "tag").groupBy("host").agg(F.countDistinct("page").alias("n_pages"), F.array_sort(F.collect_set("code")).alias("codes"))
    return out.withColumn("codes", F.array_join(F.transform("codes", lambda c: c.cast("string")), " "))
