"""Dates of event ids far beyond those of the small tables, against the query's SQL."""

import duckdb

from harvestry import registry

IDS = [0, 6, 1137738, 1137741, 1137744, 1137747, 3_000_000, 3_000_003, 6_000_000]


def test_dates_past_the_limit_of_seconds(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(i,) for i in IDS], "event_id long").selectExpr("event_id", "timestamp_ntz'2024-01-02 03:04:05' as ts").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    sql = con.sql(registry.oracle_sql()["durations_and_dates"]).select("event_id", "duration", "published", "age").fetchall()
    got = registry.queries()["durations_and_dates"](spark, str(tmp_path)).select("event_id", "duration", "published", "age").collect()
    assert sorted(map(tuple, got)) == sorted(sql)
