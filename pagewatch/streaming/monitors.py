"""Streaming forms of the stateful operators (ST1-ST9). Results go to tables in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewatch.functions.scan import scan
from pagewatch.operators import terms
from pagewatch.operators.reports import overworked
from pagewatch.sources.folders import new_folder

STATUS = "url string, n long, status string"
#: The time of the row that ends a stream: the watermark passes all windows that are open.
END = "2200-01-01 00:00:00"


def ended(stream: DataFrame, nulls: list[str], time: str = "ts") -> DataFrame:
    """stream and a last row, at END and with nulls in the given columns, so that what is open when the input ends is closed."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream-end")
    row = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name == time or f.name in nulls]
    spark.range(1).select(*row).write.parquet(folder)
    last = spark.readStream.schema(stream.select(time, *nulls).schema).parquet(folder)
    return stream.select(time, *nulls).unionByName(last)


def with_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def resource_alerts(samples: DataFrame, window: str = "10 minutes") -> DataFrame:
    """ST3, P19: windows whose peaks are over a limit; samples: ts (watermarked), url, cpu_per, mem_mb."""
    peak = samples.groupBy(F.window("ts", window).alias("w"), "url").agg(F.max("cpu_per").alias("cpu"), F.max("mem_mb").alias("mem"))
    kind = overworked(F.col("cpu"), F.col("mem"))
    return peak.select(F.col("w.start").alias("start"), "url", "cpu", "mem", kind.alias("alert_type")).where("alert_type is not null")


def visits(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """ST7, ST9: sessions of each user; events: ts (watermarked), user_id."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def first_seen(urls: DataFrame) -> DataFrame:
    """ST1: each url once within the watermark."""
    return urls.dropDuplicatesWithinWatermark(["url"])


def scanned(bodies: DataFrame, signatures: dict[str, str], key: str, body: str) -> DataFrame:
    """ST5, X6: key, signature of bodies as they come."""
    return bodies.select(key, scan(F.col(body), signatures).alias("signature"))


def _compare(days: float) -> Callable:
    most = int(days * 86_400_000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, before = state.get if state.exists else (None, 0)
        every, rows = pd.concat(list(frames)).sort_values(["ts", "hash"]), []
        for value, at in zip(every["hash"], every["ts"].astype("datetime64[ms]").astype("int64"), strict=True):
            rows.append("new" if last is None or at - before > most else "same" if value == last else "changed")
            last, before = value, at
        state.update((last, int(before)))
        state.setTimeoutTimestamp(max(int(before), state.getCurrentWatermarkMs()) + most + 1)
        found = pd.Series(rows, dtype="object").value_counts()
        yield pd.DataFrame({"url": [key[0]] * len(found), "n": found.to_numpy("int64"), "status": found.index})

    return run


def hash_changes(observed: DataFrame, days: float = 400) -> DataFrame:
    """ST2: per micro-batch and url how many observations were new, same, changed; observed: ts (watermarked), url, hash.

    After so many days without an observation a url is new again, and its state goes.
    """
    return observed.groupBy("url").applyInPandasWithState(_compare(days), STATUS, "hash string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, label: str = "stream", make: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """ST4, ST8: all that is available now, as a table: each micro-batch (by make) is a part that a repeated attempt replaces."""
    folder = new_folder(stream.sparkSession, label)
    first = make(stream).schema if make else stream.schema

    def write(batch: DataFrame, number: int) -> None:
        (make(batch) if make else batch).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(first).parquet(f"{folder}/out").drop("part")


#: State that lies on the executors' disks and is saved by its changes, so that a batch costs what it changes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state by STATE_STORE; then the session's settings hold again."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changed_frequencies(docs: DataFrame) -> DataFrame:
    """ST6, A2: of a stream of documents (doc_id, source, text) the host, word, df that a micro-batch changed; for update mode.

    The state knows the words of each page, so that a page that comes twice counts once, and the frequencies so far. A
    batch looks up its own words only.
    """
    words = terms.tokens(docs).select("host", "page", "word").dropDuplicates(["host", "page", "word"])
    return words.groupBy("host", "word").agg(F.count("*").alias("df"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """ST6: host, word, df of a stream of documents, exact: the last of each word's changed frequencies, which only grow."""
    with state_on_disk(docs.sparkSession):
        changes = run_to_table(changed_frequencies(docs), "word-frequencies", mode="update")
    return changes.groupBy("host", "word").agg(F.max("df").alias("df"))
