"""Published states: torn and killed writes are never read."""

import glob
import os
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from pagewatch.sources import commits

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_versions(spark, tmp_path):
    state = commits.Versions(spark, f"file://{tmp_path}/state")
    assert state.newest() is None
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "x") for i in range(20)], "n int, v string").repartition(3)
    assert state.publish(rows.limit(0)) == 1 and state.newest()[1].count() == 0
    assert state.publish(rows) == 2 and state.publish(rows.where("n < 7")) == 3
    assert state.newest()[0] == 3 and sorted(r.n for r in state.newest()[1].collect()) == list(range(7))
    assert state.verified(3) and state.numbers() == [3, 2, 1]
    state.damage(3)
    assert not state.whole(3) and state.newest()[0] == 2 and state.newest()[1].schema == rows.schema
    (tmp_path / "state/manifests/9.json").write_text('{"data": "x", ')
    assert state.newest()[0] == 2
    data = glob.glob(f"{tmp_path}/state/data/{state.manifest(2)['data']}/part-*")[0]
    with open(data, "r+b") as file:
        file.seek(10)
        file.write(b"\xff")
    assert state.whole(2) and not state.verified(2)  # of the same length, with other bytes


def test_a_failed_write_leaves_the_state_and_goes_with_cleaning(spark, tmp_path):
    state = commits.Versions(spark, f"file://{tmp_path}/state")
    for n in (1, 2, 3):
        state.publish(spark.range(n))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        state.publish(spark.range(9).repartition(3).select((F.lit(1) / (F.col("id") - 8)).alias("id")))
    assert state.newest()[0] == 3 and len(os.listdir(tmp_path / "state/data")) == 4
    state.clean(2)
    assert state.numbers() == [3, 2] and len(os.listdir(tmp_path / "state/data")) == 2 and state.newest()[1].count() == 3
    assert state.publish(spark.range(4)) == 4


def test_a_killed_write_is_never_read(spark, tmp_path):
    state = commits.Versions(spark, f"file://{tmp_path}/state")
    state.publish(spark.range(5))
    code = f"""
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        from pagewatch.sources import commits
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        slow = F.udf(lambda n: __import__("time").sleep(0.05) or n, "long")
        commits.Versions(spark, "file://{tmp_path}/state").publish(spark.range(0, 100_000, 1, 50).select(slow("id").alias("id")))
    """
    run = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    end = time.time() + 120
    while len(os.listdir(tmp_path / "state/data")) < 2 and time.time() < end:
        time.sleep(0.2)
    os.killpg(run.pid, 9)
    run.wait()
    assert len(os.listdir(tmp_path / "state/data")) == 2
    number, found = state.newest()
    assert (number, found.count()) == (1, 5)
