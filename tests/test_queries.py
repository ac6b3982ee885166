"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from harvestry import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    expected = con.sql(registry.oracle_sql()[name])
    assert cols == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, expected.select(*cols).fetchall()))


def test_flagship(spark):
    rows = registry.queries()["flagship_nearest_passages"](spark, DATA).collect()
    assert rows and max(r["rank"] for r in rows) <= 2


def test_session_gap_is_strict(spark):
    from harvestry.operators.state import gap_sessions

    df = spark.sql("select * from values (1, timestamp'2026-01-01 00:00:00', 1), (1, timestamp'2026-01-01 00:00:03', 2), (1, timestamp'2026-01-01 00:00:06.1', 3) t(k, ts, id)")
    assert [r["session"] for r in gap_sessions(df, ["k"], "ts", "id", 3.0).orderBy("id").collect()] == [1, 1, 2]


def test_canonical_url(spark):
    from pyspark.sql import functions as F

    from harvestry.functions.urls import canonical

    cases = {
        "HTTPS://Example.COM:443/A?utm_source=x&b=1#f": "https://example.com/A?b=1#f",
        "http://u:p@example.com/?utm_source=x": "http://u:p@example.com/?utm_source=x",
        "mailto:a@b.c": "mailto:a@b.c",
        "http://example.com:8080?fbclid=1": "http://example.com:8080",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["x"] for r in df.select("u", canonical(F.col("u")).alias("x")).collect()} == cases
