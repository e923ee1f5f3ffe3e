from pyspark.sql import functions as F

from pagewatch.functions import html, scan, text, urls
from pagewatch.plans import catalogue
from pagewatch.streaming import monitors


def test_first_seen(spark, sf):
    urls_ = monitors.with_time(catalogue._streamed(spark, sf, "events"), "365 days").select("ts", F.col("user_id").alias("url"))
    found = monitors.run_to_table(monitors.first_seen(urls_))
    assert found.count() == catalogue.read(spark, sf, "events").select("user_id").distinct().count()


def test_pages_that_come_twice_count_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h", "aa bb"), (2, "h", "aa")], "doc_id long, source string, text string")
    for part in (1, 2):
        rows.where(f"doc_id <= {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    assert {(r.word, r.df) for r in monitors.document_frequencies(stream).collect()} == {("aa", 2), ("bb", 1)}


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    texts = {0: "aa bb cc dd", 1: "aa ee", 2: "aa", 3: "ee ff"}
    for i, text_ in texts.items():
        spark.createDataFrame([(i if i < 2 else 1, "h", text_)], "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema("doc_id long, source string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with monitors.state_on_disk(spark):
        written = monitors.run_to_table(monitors.changed_frequencies(stream), "changes", mode="update")
    assert written.count() == 4 + 2 + 1  # page 1 comes three times, with one new word after the first
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert {(r.word, r.df) for r in monitors.document_frequencies(stream).collect()} == {("aa", 2), ("bb", 1), ("cc", 1), ("dd", 1), ("ee", 1), ("ff", 1)}


def test_states_go_when_nothing_comes(spark, tmp_path):
    import datetime
    import os

    schema = "ts timestamp, url string, hash string"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    os.makedirs(f"{tmp_path}/in")
    for i, rows in enumerate([[(day(0), "u", "a"), (day(0), "v", "a")], [(day(1), "v", "a")], [(day(50), "v", "b")], [(day(51), "v", "b")], [(day(51), "u", "a")]]):
        path = f"{tmp_path}/in/{i}.parquet"
        spark.createDataFrame(rows, schema).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = monitors.with_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    found = monitors.run_to_table(monitors.hash_changes(stream, days=10)).groupBy("url", "status").agg(F.sum("n").alias("n"))
    assert {(r.url, r.status): r.n for r in found.collect()} == {("u", "new"): 2, ("v", "new"): 2, ("v", "same"): 2}


def test_decode(spark):
    rows = spark.createDataFrame([(1, "日本".encode("shift_jis")), (2, "été".encode()), (3, None), (4, b"\xff\xfe\xfd")], "i int, b binary")
    found = {r.i: r.t for r in rows.select("i", scan.decode("b").alias("t")).collect()}
    assert found[1] == "日本" and found[2] == "été" and found[3] is None and found[4]


def test_small_functions(spark):
    row = spark.createDataFrame([("abcd", "a b/c+%")], "w string, u string").select(text.casings(F.col("w")).alias("c"), urls.percent_encode(F.col("u")).alias("e"), urls.percent_decode(urls.percent_encode(F.col("u"))).alias("d")).first()
    assert len(set(row.c)) == 16 and {"abcd", "ABCD", "aBcD"} <= set(row.c)
    assert row.e == "a%20b/c%2B%25" and row.d == "a b/c+%"
    page = spark.createDataFrame([('<script src="x.js"></script><img src="x.js">', "http://h/a/p")], "h string, p string")
    assert page.select(html.rewrite_scripts(F.col("h"), F.col("p"))).first()[0] == '<script src="http://h/a/x.js"></script><img src="x.js">'
