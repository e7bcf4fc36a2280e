"""Collections of which an update rewrites the touched buckets only."""

import pytest
from pyspark.sql import functions as F

from palaver.sources import store


def rows_of(spark, path, number=None):
    found = store.latest(spark, path) if number is None else store.version(spark, path, number)
    return {r["k"]: r["v"] for r in found.read(spark).collect()}


def files_of(spark, path):
    return {r[0] for r in store.latest(spark, path).read(spark).select("_metadata.file_path").distinct().collect()}


@pytest.fixture
def path(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"),
                                   F.struct(F.lit(1).alias("a"), F.col("id").alias("b")).alias("s"))
    store.create(docs, str(tmp_path / "c"), ["k"], 32)
    return str(tmp_path / "c")


def test_an_update_leaves_other_buckets_alone(spark, path):
    before = files_of(spark, path)
    s = F.struct(F.lit(2).alias("a"), F.lit(0).cast("long").alias("b")).alias("s")
    new = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (1000, "z", 1)], "k long, v string, n int").select("*", s)
    store.upsert_stored(spark, path, new, [F.col("n")])
    expected = {k: f"v{k}" for k in range(200)} | {3: "y", 1000: "z"}
    assert rows_of(spark, path) == expected
    touched = new.select(store.bucket_of(["k"], 32)).distinct().count()
    assert len(before) == 32 and len(before & files_of(spark, path)) == 32 - touched
    assert rows_of(spark, path, 0) == {k: f"v{k}" for k in range(200)}


def test_fields_are_set_in_place(spark, path):
    before = files_of(spark, path)
    values = spark.createDataFrame([(5, 9), (5000, 1)], "k long, value int")
    store.set_stored_field(spark, path, values, "s.a")
    found = store.latest(spark, path)
    assert [r["k"] for r in found.read(spark).where("s.a = 9").collect()] == [5]
    touched = values.select(store.bucket_of(["k"], 32)).distinct().count()
    assert len(before & files_of(spark, path)) == 32 - touched
    store.set_stored_field(spark, path, values, "extra")
    assert {r["k"]: r["extra"] for r in store.latest(spark, path).read(spark).where("k < 7").collect()} == {
        **dict.fromkeys(range(7)), 5: 9}
    assert store.set_stored_field(spark, path, values.limit(0), "extra").number == 2


def test_readers_see_an_update_only_when_it_is_done(spark, path):
    bad = spark.createDataFrame([(3,)], "k long").select(
        "k", F.raise_error(F.lit("lost")).cast("string").alias("v"),
        F.struct(F.lit(1).alias("a"), F.col("k").alias("b")).alias("s"))
    with pytest.raises(Exception, match="lost"):
        store.upsert_stored(spark, path, bad)
    # Files of an update that never got to its manifest.
    spark.createDataFrame([(3, "half", None)], "k long, v string, s struct<a int, b bigint>").withColumn(
        "bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/generation=1")
    assert store.latest(spark, path).number == 0 and rows_of(spark, path)[3] == "v3"
    good = store.latest(spark, path).read(spark).where("k = 3").withColumn("v", F.lit("good"))
    store.upsert_stored(spark, path, good)
    assert rows_of(spark, path) == {k: f"v{k}" for k in range(200)} | {3: "good"}


def test_empty_collections_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "e")
    store.create(spark.createDataFrame([], "k string, n long, v string"), path, ["k", "n"], 4)
    assert store.latest(spark, path).read(spark).columns == ["k", "n", "v"] and rows_of(spark, path) == {}
    new = spark.createDataFrame([("a", None, "1"), ("b", 2, "2")], "k string, n long, v string")
    store.upsert_stored(spark, path, new)
    assert rows_of(spark, path) == {"a": "1", "b": "2"}
    assert store.upsert_stored(spark, path, new.limit(0)).number == 1
    with pytest.raises(ValueError):
        store.create(new.withColumn("bucket", F.lit(1)), str(tmp_path / "f"), ["k"], 4)
