"""Every query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from pagewatch.plans import catalogue


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, oracle, name):
    got = catalogue.QUERIES[name](spark, sf)
    found = [tuple(r) for r in got.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert found
        return
    want = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, found) == rows(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "initial_url", "url", "verdict"]
