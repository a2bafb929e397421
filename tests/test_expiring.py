"""Streaming scores with expiring state equal the batch, whatever expires, restarts or arrives twice."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from probitas.operators import samples as SM
from probitas.plans.inputs import Inputs
from probitas.plans.sample_queries import _prompts
from probitas.streaming import expiring as X

COLS = SM.GROUP + ["n_samples", "n_yes", "n_no", "n_undefined", "mean", "coherence", "validity", "weighted"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


@pytest.fixture(scope="module")
def arrivals(spark):
    """Samples in three files, the earliest in the second, and the scores of all."""
    samples, prompts = Inputs.of(spark, SF_SMALL).samples, _prompts(spark, SF_SMALL)
    a, b = samples.agg(F.expr("percentile_approx(sample_order, array(0.2, 0.5))")).first()[0]
    order = F.col("sample_order")
    parts = [samples.where((order >= a) & (order < b)), samples.where(order < a), samples.where(order >= b)]
    want = _rows(SM.sample_scores(SM.label_samples(SM.first_n_samples(samples), prompts)))
    assert want
    return samples, prompts, parts, want


def _state(spark, checkpoint):
    return (spark.read.format("statestore").option("stateVarName", X.STATE).load(checkpoint)
            .select("key.*").distinct())


def test_state_is_freed_and_late_samples_still_count(spark, arrivals):
    samples, prompts, parts, want = arrivals
    root = tempfile.mkdtemp(prefix="probitas-expire-", dir="/tmp")
    last = parts[2].where(F.col("criterion_id") == parts[2].agg(F.min("criterion_id")).first()[0])
    for k, new in enumerate([parts[0], parts[1], parts[2].subtract(last), last]):
        new.write.parquet(f"{root}/src/b{k}")
        X.run_expiring(spark, f"{root}/src/*", samples.schema, prompts, f"{root}/out", f"{root}/ckpt", idle_seconds=0.5)
        if k == 0:
            assert _state(spark, f"{root}/ckpt").count() > 0
        time.sleep(1)
    changed = SM.drop_empty_responses(last).select(*SM.GROUP).distinct()
    assert _state(spark, f"{root}/ckpt").count() <= changed.count()  # all others were quiet and are gone
    assert _rows(X.current_scores(X.read_changes(spark, f"{root}/out"))) == want


def test_new_checkpoint_starts_from_open_groups(spark, arrivals):
    samples, prompts, parts, want = arrivals
    root = tempfile.mkdtemp(prefix="probitas-expire-", dir="/tmp")
    for k, new in enumerate(parts):
        new.write.parquet(f"{root}/src{k}/b")
        before = X.current(X.read_changes(spark, f"{root}/out")).where(F.size("orders") < 5).count()
        X.run_expiring(spark, f"{root}/src{k}/*", samples.schema, prompts, f"{root}/out", f"{root}/ckpt{k}")
        assert _state(spark, f"{root}/ckpt{k}").count() >= before
    assert _rows(X.current_scores(X.read_changes(spark, f"{root}/out"))) == want
    # the last files once more, and a restart of the first checkpoint without new files, change nothing
    X.run_expiring(spark, f"{root}/src2/*", samples.schema, prompts, f"{root}/out", f"{root}/ckpt-again")
    X.run_expiring(spark, f"{root}/src0/*", samples.schema, prompts, f"{root}/out", f"{root}/ckpt0")
    assert _rows(X.current_scores(X.read_changes(spark, f"{root}/out"))) == want


def test_empty_source_and_empty_table(spark, arrivals):
    samples, prompts, _, _ = arrivals
    root = tempfile.mkdtemp(prefix="probitas-expire-", dir="/tmp")
    samples.where("false").write.parquet(f"{root}/src/b")
    X.run_expiring(spark, f"{root}/src/*", samples.schema, prompts, f"{root}/out", f"{root}/ckpt", idle_seconds=60)
    assert X.current_scores(X.read_changes(spark, f"{root}/out")).count() == 0
