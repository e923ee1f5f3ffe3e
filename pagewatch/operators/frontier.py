"""The work frontier: discovery by rounds, de-duplication and scheduling (J7-J9, ST1, T3, T8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions.names import unused
from pagewatch.sources.folders import table


def crawl(seeds: DataFrame, edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """node, hop: what seeds (node) reach along edges (src, dst), by the fewest steps, until there is nothing new or most_hops is reached."""
    seen = table(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "frontier")
    last, hop = seen, 0
    while most_hops is None or hop < most_hops:
        hop += 1
        found = edges.join(last, edges.src == last.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        last = table(found.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def first_pages(reached: DataFrame, most: int) -> DataFrame:
    """At most so many nodes of crawl(), those of fewer hops first, then by node."""
    return reached.orderBy("hop", "node").limit(most)


def saves(visits: DataFrame, every: int) -> DataFrame:
    """T8, ST8: visits (ts in seconds) and part: the span of `every` seconds since the first visit after which the state is saved."""
    (first,) = unused(visits, "start")
    start = visits.agg(F.min("ts").alias(first))
    return visits.join(F.broadcast(start), F.col("ts") >= F.col(first)).withColumn("part", F.floor((F.col("ts") - F.col(first)) / every)).drop(first)


def schedule(hosts: DataFrame, most: int) -> DataFrame:
    """Host, n, turn: the host with the fewest urls first, then those with most; hosts without urls never."""
    waiting = hosts.where("n > 0")
    first = waiting.orderBy("n", "host").limit(1)
    rest = waiting.join(first.select("host"), "host", "left_anti").orderBy(F.desc("n"), "host").limit(most - 1)
    return first.withColumn("turn", F.lit("first")).unionByName(rest.withColumn("turn", F.lit("largest")))


def pulled(queued: DataFrame, free: int) -> DataFrame:
    """ST1: host, url, turn: what idle workers get, one url of each host at a time, the hosts in the order of schedule()."""
    own = Window.partitionBy("host").orderBy("url")
    turns = schedule(queued.groupBy("host").agg(F.count("*").alias("n")), free).select("host", "turn")
    return queued.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth").join(F.broadcast(turns), "host")


def recovered(verdicts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Allowed urls of the verdict store that were never assigned; src says where they come from."""
    return verdicts.where("verdict = 'ALLOW'").select("url").distinct().join(assigned, "url", "left_anti").withColumn("src", F.lit("url_db"))
