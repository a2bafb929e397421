"""Stored tables: upserts in touched partitions, an atomic switch, failed and concurrent changes."""

import glob
import tempfile

import pytest
from probitas.sources import store as ST
from pyspark.sql import functions as F

SCHEMA = "model string, language string, score double"


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="probitas-store-", dir="/tmp") + "/scores"


def rows(df):
    return sorted(map(tuple, df.select("model", "language", "score").collect()), key=repr)


def put(spark, root, data, **how):
    return ST.upsert(spark.createDataFrame(data, SCHEMA), root, ["model", "language"], ["model"], **how)


def test_two_upserts_touch_only_their_partitions(spark, root):
    assert not ST.store_exists(spark, root)
    put(spark, root, [("a", "en", 1.0), ("a", "fr", 2.0), ("b", "en", 3.0), (None, "en", 4.0)])
    files = {f for f in glob.glob(f"{root}/run=*/model=b/*.parquet")}
    assert put(spark, root, [("a", "fr", 9.0), ("a", None, 8.0), ("c/d=e", "en", 7.0)]) == ["model=a", "model=c%2Fd%3De"]
    assert rows(ST.read_store(spark, root)) == sorted([("a", "en", 1.0), ("a", "fr", 9.0), ("a", None, 8.0), ("b", "en", 3.0), (None, "en", 4.0),
                                                       ("c/d=e", "en", 7.0)], key=repr)
    put(spark, root, [("a", None, 6.0), (None, "en", 5.0)])
    now = rows(ST.read_store(spark, root))
    assert ("a", None, 6.0) in now and (None, "en", 5.0) in now and len(now) == 6
    assert files == {f for f in glob.glob(f"{root}/run=*/model=b/*.parquet")}  # never written again
    assert len(rows(ST.read_store(spark, root, version=1))) == 4
    assert ST.vacuum(spark, root) == 0 and rows(ST.read_store(spark, root)) == now  # every run still holds a partition
    assert len(glob.glob(f"{root}/run=*/model=a")) == 1 and len(glob.glob(f"{root}/_versions/[0-9]*")) == 1


def test_insert_only_keeps_stored_rows(spark, root):
    put(spark, root, [("a", "en", 1.0)])
    put(spark, root, [("a", "en", 2.0), ("a", "fr", 2.0)], insert_only=True)
    assert rows(ST.read_store(spark, root)) == [("a", "en", 1.0), ("a", "fr", 2.0)]
    assert put(spark, root, []) == [] and ST.latest_version(spark, root) == 2


def test_a_failed_run_leaves_the_old_state(spark, root, monkeypatch):
    put(spark, root, [("a", "en", 1.0), ("b", "en", 1.0)])
    bad = spark.createDataFrame([("a", "en", 2.0), ("b", "en", 2.0)], SCHEMA).withColumn(
        "score", F.when(F.col("model") == "b", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        ST.upsert(bad, root, ["model", "language"], ["model"])
    assert rows(ST.read_store(spark, root)) == [("a", "en", 1.0), ("b", "en", 1.0)]

    def stops(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # all partitions written, the switch not made
        m.setattr(ST, "_publish", stops)
        with pytest.raises(KeyboardInterrupt):
            put(spark, root, [("a", "en", 3.0)])
    assert rows(ST.read_store(spark, root)) == [("a", "en", 1.0), ("b", "en", 1.0)]
    assert ST.vacuum(spark, root) >= 1
    put(spark, root, [("a", "en", 3.0)])
    assert rows(ST.read_store(spark, root)) == [("a", "en", 3.0), ("b", "en", 1.0)]


def test_the_second_of_two_changes_fails(spark, root, monkeypatch):
    put(spark, root, [("a", "en", 1.0)])
    publish = ST._publish

    def late(s, r, version, schema, folders):
        monkeypatch.setattr(ST, "_publish", publish)
        put(spark, root, [("a", "en", 5.0)])
        publish(s, r, version, schema, folders)

    monkeypatch.setattr(ST, "_publish", late)
    with pytest.raises(ST.ConcurrentChange):
        put(spark, root, [("a", "en", 4.0)])
    assert rows(ST.read_store(spark, root)) == [("a", "en", 5.0)]


def test_partition_values_keep_their_type(spark, root):
    put(spark, root, [("1", "en", 1.0)])
    put(spark, root, [("007", "en", 2.0), ("1", "en", 3.0)])
    assert rows(ST.read_store(spark, root)) == [("007", "en", 2.0), ("1", "en", 3.0)]


def test_bad_updates(spark, root):
    with pytest.raises(ValueError, match="several rows"):
        put(spark, root, [("a", "en", 1.0), ("a", "en", 2.0)])
    with pytest.raises(ValueError, match="part of the key"):
        ST.upsert(spark.createDataFrame([("a", "en", 1.0)], SCHEMA), root, ["language"], ["model"])
    with pytest.raises(FileNotFoundError):
        ST.read_store(spark, root)
