"""Without any automatic broadcast the shuffle-join plans give the same results."""

import contextlib
import io

from conftest import SF_SMALL
from probitas.operators import samples as SM
from probitas.plans.inputs import Inputs
from probitas.plans.sample_queries import _prompts


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_shuffle_join_fallback_matches(spark):
    inp = Inputs.of(spark, SF_SMALL)
    want_cmp = _rows(inp.comparison())
    want_smp = _rows(SM.sample_scores(SM.label_samples(SM.first_n_samples(inp.samples), _prompts(spark, SF_SMALL))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cmp_df = inp.comparison()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            cmp_df.explain()
        plan = buf.getvalue()
        assert "SortMergeJoin" in plan
        assert _rows(cmp_df) == want_cmp and len(want_cmp) > 0
        smp = SM.sample_scores(SM.label_samples(SM.first_n_samples(inp.samples), _prompts(spark, SF_SMALL)))
        assert _rows(smp) == want_smp
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
