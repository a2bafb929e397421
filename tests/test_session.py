"""Session helpers, and what building a query must not do."""

import tempfile

import pytest
from conftest import SF_SMALL
from probitas.operators.compare import weighted_totals
from probitas.plans import evaluate as EV
from probitas.plans.inputs import Inputs
from probitas.session import checkpoint_root, materialize, path_exists


def test_materialize_under_checkpoint_root(spark):
    df = materialize(spark.range(7), "unit-test")
    assert df.count() == 7
    assert checkpoint_root(spark)


def test_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}
    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoint_root(Session)


def test_paths_are_looked_up_on_their_file_system(spark):
    here = tempfile.mkdtemp(prefix="probitas-path-", dir="/tmp")
    assert path_exists(spark, f"file://{here}") and path_exists(spark, here)
    assert not path_exists(spark, f"file://{here}/none")
    EV.require(spark, {"a": f"file://{here}"})
    with pytest.raises(EV.MissingInput, match="none"):
        EV.require(spark, {"a": f"file://{here}/none"})


def test_building_a_query_starts_no_job_and_caches_nothing(spark):
    inp = Inputs.of(spark, SF_SMALL)
    for name in ("item_scores", "truth_long", "weights", "units", "samples", "prompts"):
        getattr(inp, name)  # staged inputs are jobs of their own
    spark.sparkContext.setJobGroup("build-only", "")
    try:
        inp.comparison()
        inp.comparison()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("build-only")) == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_rows_added_to_a_dimension_are_seen(spark):
    inp = Inputs.of(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="probitas-weights-", dir="/tmp") + "/w"
    inp.weights.where("criterion_id < 10").write.parquet(path)
    before = weighted_totals(inp.item_scores, spark.read.parquet(path), inp.rules).agg({"n_items": "max"}).first()[0]
    inp.weights.where("criterion_id >= 10").write.mode("append").parquet(path)
    after = weighted_totals(inp.item_scores, spark.read.parquet(path), inp.rules).agg({"n_items": "max"}).first()[0]
    assert before == 7 and after == inp.rules.n_items
