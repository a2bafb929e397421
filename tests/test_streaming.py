"""Streaming incremental scoring equals the batch scoring, whatever the order of arrival."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from probitas.operators import samples as SM
from probitas.plans.inputs import Inputs
from probitas.plans.sample_queries import _prompts
from probitas.session import materialize
from probitas.streaming.incremental import latest_scores, run_incremental


COLS = SM.GROUP + ["n_samples", "n_yes", "n_no", "n_undefined", "mean", "coherence", "validity", "weighted"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_stream_and_increments_match_batch(spark):
    """Three arrivals of unequal size, the earliest samples in the middle one."""
    root = tempfile.mkdtemp(prefix="probitas-stream-", dir="/tmp")
    samples = Inputs.of(spark, SF_SMALL).samples
    prompts = _prompts(spark, SF_SMALL)
    q = samples.agg(F.expr("percentile_approx(sample_order, array(0.2, 0.5))")).first()[0]
    order = F.col("sample_order")
    arrivals = [samples.where((order >= q[0]) & (order < q[1])), samples.where(order < q[0]), samples.where(order >= q[1])]
    want = _rows(SM.sample_scores(SM.label_samples(SM.first_n_samples(samples), prompts)))
    src, sink, ckpt = f"{root}/src", f"{root}/sink", f"{root}/ckpt"
    stored = scored = None
    for k, new in enumerate(arrivals):
        new.write.parquet(f"{src}/b{k}")
        run_incremental(spark, f"{src}/*", samples.schema, prompts, sink, ckpt)
        if k == 0:
            stored = materialize(SM.first_n_samples(new), "t")
            scored = materialize(SM.sample_scores(SM.label_samples(stored, prompts)), "t")
        else:
            scored = materialize(SM.incremental_scores(scored, stored, new, prompts), "t")
            stored = materialize(SM.first_n_samples(stored.select(*new.columns).unionByName(new)), "t")
    assert _rows(latest_scores(spark, sink)) == want and _rows(scored) == want and len(want) > 0
