"""Lookups by units: files of other partitions are not opened, in a plain and in a versioned store."""

import shutil
import tempfile

import pytest
from probitas.sources import io as IO
from probitas.sources import store as ST
from pyspark.sql import functions as F

ANSWER = "scenario string, model string, unit_key string, criterion_id int, fact double"


def _answers(spark):
    return spark.createDataFrame([(s, m, u, c, 0.5) for s in ("s1", "s2") for m in ("a", "b/c", "d=e") for u in ("IT", "DE") for c in range(3)], ANSWER)


def _units(spark, *units):
    rows = spark.createDataFrame(list(units) or [("", "", "")], "scenario string, model string, unit_key string")
    return rows if units else rows.where(F.lit(False))


def _rows(df):
    return sorted(map(tuple, df.select("scenario", "model", "unit_key", "criterion_id").collect()))


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="probitas-lookup-", dir="/tmp") + "/answers"


def test_a_plain_store_is_pruned_when_it_is_read(spark, root):
    _answers(spark).write.partitionBy("scenario", "model").parquet(root)
    units = _units(spark, ("s1", "b/c", "IT"), ("s1", "b/c", "IT"), ("s9", "a", "IT"))
    units.write.parquet(root + "-units")  # a table whose values the planner does not know
    got = IO.scan_answer_store(spark, root, units=spark.read.parquet(root + "-units"))
    assert got.columns == IO.scan_answer_store(spark, root).columns
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    for folder in ("scenario=s2", "scenario=s1/model=d%3De"):  # the plan is made; other partitions' files are lost
        for f in spark._jvm.java.io.File(f"{root}/{folder}").listFiles():
            if not f.isDirectory():
                shutil.copyfile(__file__, f.getPath())  # no Parquet any more: opening it would fail
    assert _rows(got) == [("s1", "b/c", "IT", c) for c in range(3)]


def test_a_versioned_store_opens_only_the_partitions_asked_for(spark, root):
    ST.append(_answers(spark), root, ["scenario", "model"])
    ST.append(_answers(spark).where("unit_key = 'IT'").withColumn("criterion_id", F.col("criterion_id") + 3), root, ["scenario", "model"])
    units = _units(spark, ("s1", "d=e", "IT"), ("s2", "b/c", "XX"), ("s9", "a", "IT"), (None, "a", "IT"))
    got = IO.scan_answer_store(spark, root, units=units)
    assert _rows(got) == [("s1", "d=e", "IT", c) for c in range(6)]  # both runs of the partition
    read = ST.read_store(spark, root, only=units)
    folders = {"/".join(f.split("/")[-3:-1]) for f in read.inputFiles()}
    assert {f.replace("%25", "%") for f in folders} == {"scenario=s1/model=d%3De", "scenario=s2/model=b%2Fc"} and read.count() == 18
    assert ST.lookup(spark, root, _units(spark), ["scenario", "model", "unit_key"]).count() == 0
    assert ST.read_store(spark, root, only=_units(spark, ("s9", "z", "IT"))).columns == _answers(spark).columns


def test_partitions_by_null_and_number(spark, root):
    rows = spark.createDataFrame([(1, "x", 1.0), (None, "x", 2.0), (10, None, 3.0), (10, "", 4.0)], "k int, name string, v double")
    ST.append(rows, root, ["k", "name"])
    look = lambda *keys: sorted(r.v for r in ST.lookup(spark, root, spark.createDataFrame(list(keys), "k long, name string"), ["k", "name"]).collect())
    assert look((1, "x"), (None, "x")) == [1.0, 2.0] and look((10, None)) == [3.0, 4.0] and look((1, None)) == []


def test_an_upsert_reads_only_what_it_touches(spark, root):
    keys = ["scenario", "model", "unit_key", "criterion_id"]
    ST.upsert(_answers(spark), root, keys, ["scenario", "model"])
    for f in ST.read_store(spark, root, only=_units(spark, ("s2", "a", ""))).inputFiles():
        shutil.copyfile(__file__, f.removeprefix("file://").removeprefix("file:"))  # would fail if it were read
    new = _answers(spark).where("scenario = 's1' and model = 'a' and unit_key = 'IT'").withColumn("fact", F.lit(1.0))
    assert ST.upsert(new, root, keys, ["scenario", "model"]) == ["scenario=s1/model=a"]
    touched = ST.read_store(spark, root, only=_units(spark, ("s1", "a", "")))
    assert sorted((r.unit_key, r.fact) for r in touched.collect()) == [("DE", 0.5)] * 3 + [("IT", 1.0)] * 3
