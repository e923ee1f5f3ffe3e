"""Roll-ups, resource peaks and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.names import unused

from pagewatch.operators.history import stringified

#: Shares of CPU and MB of memory over which a page overworks its machine.
CPU_LIMIT, MEMORY_LIMIT = 60.0, 2000.0


def rollup(rows: DataFrame) -> DataFrame:
    """Server (null: all), pages, files, total, the largest total first; rows: server, pages, files."""
    out = rows.rollup("server").agg(F.sum("pages").alias("pages"), F.sum("files").alias("files"))
    return out.withColumn("total", F.col("pages") + F.col("files")).orderBy(F.desc("total"), "server")


def progress(queues: DataFrame) -> DataFrame:
    """Hosts, empty_hosts, remaining; queues: host, n."""
    return queues.agg(F.count("*").alias("hosts"), F.count_if(F.col("n") == 0).alias("empty_hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("remaining"))


def merge_runs(parts: DataFrame) -> DataFrame:
    """run_time summed, and the count up to and with the first part that leaves nothing: parts: part, run_time, remaining, achieved."""
    ended = F.coalesce(F.min(F.when(F.col("remaining") == 0, F.col("part"))), F.max("part"))
    last = parts.agg(ended.alias("last"), F.sum("run_time").alias("total"))
    return parts.join(F.broadcast(last), F.col("part") == F.col("last")).select(F.col("total").alias("run_time"), "achieved", "last")


def peaks(samples: DataFrame, window: str = "10 minutes") -> DataFrame:
    """A10: start, url, cpu, mem: the most in each window; samples: ts, url, cpu_per, mem_mb."""
    out = samples.groupBy(F.window("ts", window).alias("w"), "url").agg(F.max("cpu_per").alias("cpu"), F.max("mem_mb").alias("mem"))
    return out.select(F.col("w.start").alias("start"), "url", "cpu", "mem")


def normalised(samples: DataFrame, cores: int) -> DataFrame:
    """samples with cpu_per (share of all cores) and mem_mb, of cpu_all (summed over cores) and mem_bytes."""
    return samples.withColumns({"cpu_per": F.col("cpu_all") / cores, "mem_mb": F.floor(F.col("mem_bytes") / 1_000_000).cast("int")})


def overworked(cpu: Column, mem: Column) -> Column:
    """P19."""
    return F.when(cpu > CPU_LIMIT, "over_work_cpu").when(mem > MEMORY_LIMIT, "over_work_memory")


def pivot_downloads(events: DataFrame, fields: list[str]) -> DataFrame:
    """No and a column a field; events: no, field, value. Missing fields are "None"."""
    wide = events.groupBy("no").pivot("field", fields).agg(F.max("value"))
    return wide.select("no", *(F.coalesce(f, F.lit("None")).alias(f) for f in fields))


def timers(messages: DataFrame, key: str, stall: int = 300, idle: int = 60) -> DataFrame:
    """W6, ST7: key, quiet (whole seconds since its last message, up to the last of all), stalled, idle; messages: key, ts."""
    rows = messages.groupBy(key).agg(F.max(F.col("ts").cast("double")).alias("last"))
    rows = rows.join(F.broadcast(rows.agg(F.max("last").alias("now"))), F.col("last") <= F.col("now"))  # the one row of the latest time
    quiet = F.floor(F.col("now") - F.col("last"))
    return rows.select(key, quiet.alias("quiet"), (quiet > stall).alias("stalled"), (quiet > idle).alias("idle"))


def is_test(url: Column, test_hosts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(url, F.lit(h)) for h in test_hosts], F.lit(False))


def alerts(nth: int, test_hosts: list[str], **kinds: DataFrame) -> DataFrame:
    """Nth, alert_type, url, content of every kind (url, content) of alert; those of test hosts are named TEST_."""
    parts = []
    for kind, rows in kinds.items():
        name = F.when(is_test(F.col("url"), test_hosts), f"TEST_{kind}").otherwise(kind)
        parts.append(rows.select(F.lit(nth).alias("nth"), name.alias("alert_type"), F.col("url").cast("string"), F.col("content").cast("string")))
    return reduce(DataFrame.unionByName, parts)


def without_tests(found: DataFrame) -> DataFrame:
    """Alerts but those of test hosts."""
    return found.where(~F.startswith("alert_type", F.lit("TEST_")))


#: Kinds of alert that a switch of the settings turns off.
SWITCHES = {
    "words": ["hack_word_Lv2", "hack_word_Lv3", "change_important_word", "new_page_without_frequent_word"], "scan": ["warning_clamd"],
    "browser": ["request_to_new_server", "url_history", "download_url", "new_window_url", "alert_text", "about_blank_url", "over_work"],
}


def switched(found: DataFrame, settings: DataFrame) -> DataFrame:
    """Alerts but those that the settings (key, value) switch off; a switch that they don't name is on."""
    pairs = [(key, kind) for key, kinds in SWITCHES.items() for kind in kinds]
    known = found.sparkSession.createDataFrame(pairs, "key string, kind string")
    (of,) = unused(found, "kind")
    off = known.join(settings.where("lower(value) = 'false'").select("key"), "key").select(F.col("kind").alias(of))
    rows = found.withColumn(of, F.regexp_replace("alert_type", "^TEST_", ""))
    return rows.join(F.broadcast(off), of, "left_anti").drop(of)  # at most as many rows as SWITCHES has


def strange_sets(rows: DataFrame, is_strange: Column) -> DataFrame:
    """url, content: of each page (url) with a strange value, these; rows: url, value."""
    found = rows.where(is_strange).groupBy("url").agg(F.collect_set("value").alias("values"))
    return found.select("url", stringified(F.col("values")).alias("content"))
