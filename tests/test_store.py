"""Versions of a store: whole or not at all, once or twice, old ones readable; merging with new numbers."""

import pytest
from pyspark.sql import functions as F

from harvestry.sources import store


@pytest.fixture
def folder(spark, tmp_path):
    store.register(spark)
    return str(tmp_path / "store")


def put(df, folder, mode="append", **options):
    df.write.format(store.FORMAT).options(path=folder, **options).mode(mode).save()


def get(spark, folder, **options):
    return sorted(tuple(r) for r in spark.read.format(store.FORMAT).options(path=folder, **options).load().collect())


def test_versions(spark, folder):
    a = spark.createDataFrame([(1, "a", [1.5]), (2, None, [])], "id long, x string, v array<double>").repartition(2)
    b = spark.createDataFrame([(3, "c", None)], a.schema)
    put(a, folder)
    put(b, folder, batch="b-1")
    put(b, folder, batch="b-1")
    whole = [(1, "a", [1.5]), (2, None, []), (3, "c", None)]
    assert get(spark, folder) == whole and store.Manifests(folder).versions() == [1, 2]
    put(b, folder, "overwrite")
    assert get(spark, folder) == [(3, "c", None)] and get(spark, folder, version=2) == whole and len(get(spark, folder, version=1)) == 2
    put(b.limit(0), folder, "overwrite")
    assert get(spark, folder) == [] and store.Manifests(folder).versions() == [1, 2, 3, 4]


def test_failed_write_leaves_the_old_version(spark, folder):
    import glob

    a = spark.range(100).selectExpr("id", "cast(id as string) as x")
    put(a, folder)
    before = sorted(glob.glob(f"{folder}/data/*"))
    broken = spark.range(0, 100, 1, 4).selectExpr("id", "case when id = 99 then raise_error('lost') else 'y' end as x")
    with pytest.raises(Exception, match="lost"):
        put(broken, folder)
    assert get(spark, folder) == sorted((i, str(i)) for i in range(100)) and store.Manifests(folder).versions() == [1]
    store.Manifests(folder).vacuum()
    assert sorted(glob.glob(f"{folder}/data/*")) == before and store.Manifests(folder).vacuum() == 0
    with pytest.raises(Exception, match="other columns"):
        put(spark.range(3), folder)
    assert len(get(spark, folder)) == 100


def test_uri_and_nothing(spark, folder):
    put(spark.range(3), f"file://{folder}")
    assert get(spark, f"file://{folder}") == [(0,), (1,), (2,)]
    with pytest.raises(Exception, match="nothing is stored"):
        get(spark, f"{folder}-none")


def test_merge(spark):
    old = spark.createDataFrame([("i", 1, "s1", "old"), ("i", 2, "s2", "old"), ("i", 3, None, "old"), ("j", 1, "s1", "old")], "item string, n int, source string, x string")
    new = spark.createDataFrame([("i", 5, "s1", "new"), ("i", 4, "s9", "new"), ("k", 1, "s1", "new")], "item string, position int, source string, x string")
    got = store.merged(old.withColumn("position", F.lit(0)), new.withColumn("n", F.lit(0)), "source", "item", "position")
    assert sorted((r["item"], r["n"], r["source"], r["x"]) for r in got.collect()) == [("i", 1, "s2", "old"), ("i", 2, None, "old"), ("i", 3, "s9", "new"), ("i", 4, "s1", "new"), ("j", 1, "s1", "old"), ("k", 1, "s1", "new")]
