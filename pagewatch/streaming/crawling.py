"""The crawl as a stream whose state outlives it: each host's queue, what it was given, and its limits (ST1, T8, J7-J9, ST8).

A run reads the urls that were found, and gives each host's next ones out; what their pages link to is found for the
next run. State and progress lie in one folder, so a crawl that stops goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewatch.streaming.monitors import state_on_disk

FOUND = "host string, url string, hop int, ts long"
GIVEN = "host string, url string, hop int, ts long, waiting long"


@dataclass
class Limits:
    """None: no limit. pages: urls that a host is given in all. turn: urls that it is given in a run. seconds: from its first url on."""

    pages: int | None = None
    turn: int | None = None
    seconds: int | None = None


class _Host(StatefulProcessor):
    """State of a host: urls given, urls waiting (with their hops), its first time and how many it was given."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "url string", "hop int")
        self.queue = handle.getMapState("queue", "url string", "hop int")
        self.so_far = handle.getValueState("so_far", "began long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = None
        for frame in rows:
            for url, hop, ts in zip(frame["url"], frame["hop"], frame["ts"], strict=True):
                now = int(ts) if now is None else max(now, int(ts))
                if url is None or pd.isna(url) or self.given.containsKey((url,)):  # a null url only says that others wait
                    continue
                if not self.queue.containsKey((url,)) or self.queue.getValue((url,))[0] > hop:
                    self.queue.updateValue((url,), (int(hop),))
        began, n = self.so_far.get() if self.so_far.exists() else (now, 0)
        waiting = sorted((hop, url) for (url,), (hop,) in self.queue.iterator())
        limits, room = self.limits, len(waiting)
        if limits.turn is not None:
            room = min(room, limits.turn)
        if limits.pages is not None:
            room = min(room, limits.pages - n)
        if limits.seconds is not None and now - began > limits.seconds:
            room = 0
        mine = waiting[: max(room, 0)]
        for hop, url in mine:
            self.given.updateValue((url,), (hop,))
            self.queue.removeKey((url,))
        self.so_far.update((began, n + len(mine)))
        over = (limits.pages is not None and n + len(mine) >= limits.pages) or (limits.seconds is not None and now - began > limits.seconds)
        left = 0 if over else len(waiting) - len(mine)
        if mine or left:
            out = mine or [(0, None)]
            yield pd.DataFrame({"host": key[0], "url": [u for _, u in out], "hop": pd.array([h for h, _ in out], "int32"), "ts": now, "waiting": left})

    def close(self) -> None:
        pass


def _batch(number: int, batch: DataFrame, links: DataFrame, folder: str) -> None:
    """Writes what was given out, and for the next run what those pages link to and hosts in which urls wait. Repeating it gives the same."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{folder}/given/part={number}")
    mine = spark.read.schema(GIVEN).parquet(f"{folder}/given/part={number}")
    new = mine.where("url is not null").join(links, F.col("url") == F.col("src")).groupBy(F.col("to_host").alias("host"), F.col("dst").alias("url")).agg((F.min("hop") + 1).alias("hop"), (F.max("ts") + 1).alias("ts"))
    wait = mine.where("waiting > 0").groupBy("host").agg((F.max("ts") + 1).alias("ts")).selectExpr("host", "cast(null as string) url", "0 hop", "ts")
    found = new.unionByName(wait).select("host", "url", F.col("hop").cast("int").alias("hop"), "ts")
    if not found.isEmpty():  # a folder without rows would call for another run
        found.write.mode("overwrite").parquet(f"{folder}/found/after={number}")


def given(spark: SparkSession, folder: str) -> DataFrame:
    """host, url, hop of every url that the crawl in that folder has given out."""
    return spark.read.schema(GIVEN).parquet(f"{folder}/given").where("url is not null").select("host", "url", "hop")


def crawl(seeds: DataFrame, links: DataFrame, folder: str, limits: Limits = Limits(), most_runs: int | None = None) -> DataFrame:  # noqa: B008
    """ST1: host, url, hop of what the seeds (host, url) reach along links (src, to_host, dst), each url once; a run's time is its number.

    Each run is a micro-batch: every host gets its waiting urls of fewest hops, then by url, as far as the limits allow; what its
    limits shut out is never given. With no limits, hops are those of frontier.crawl(). folder is one that the cluster
    shares; if a crawl has begun there, it goes on with the state that was saved, and seeds are left out. Null urls are left out.
    """
    spark = seeds.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/found/after=seeds")
    disk = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not disk.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/found/after=seeds/_SUCCESS")):
        first = seeds.where("url is not null").select("host", "url", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("ts")).distinct()
        first.write.mode("overwrite").parquet(f"{folder}/found/after=seeds")
    known = links.select("src", "to_host", "dst").where("dst is not null")
    found = spark.readStream.schema(FOUND).parquet(f"{folder}/found/*")
    rows = found.groupBy("host").transformWithStateInPandas(_Host(limits), outputStructType=GIVEN, outputMode="Update", timeMode="None")
    stream = rows.writeStream.foreachBatch(lambda batch, number: _batch(number, batch, known, folder)).outputMode("update").option("checkpointLocation", f"{folder}/state")
    with state_on_disk(spark):
        if most_runs is None:
            crawling = stream.start()
            try:
                crawling.processAllAvailable()  # what a run finds is there before the next one looks
            finally:
                crawling.stop()
        for _ in range(most_runs or 0):
            stream.trigger(availableNow=True).start().awaitTermination()
    return given(spark, folder)
