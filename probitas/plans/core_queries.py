"""Registered queries: units, gate, adjustment and comparison (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probitas import rules as R
from probitas.functions.numeric import np_round
from probitas.operators import adjust as A
from probitas.operators import compare as C
from probitas.operators import units as U
from probitas.plans import sql_inputs as S
from probitas.plans.inputs import Inputs, staged_comparison
from probitas.plans.registry import register
from probitas.rules import TEST_RULES
from probitas.sources import driver_tables as D

N76 = R.PUBLISHED_N_CRITERIA
BASE = lambda: [S.cte_countries(), S.cte_pairs(), S.cte_units()]


@register("comparison_table", S.with_inputs("SELECT * FROM comparison", *S.comparison_inputs()))
def comparison_table(spark, sf_dir):
    """Per (model, scenario, country, language): totals, MAE and signed-rank test."""
    return staged_comparison(spark, sf_dir, again=True)


@register("mae_vs_truth", S.with_inputs(
    "SELECT scenario, model, unit_key, country_id, fact_mae, stance_mae FROM ustats", *S.comparison_inputs()))
def mae_vs_truth(spark, sf_dir):
    """Mean absolute error of the adjusted weighted vectors against the truth."""
    inp = Inputs.of(spark, sf_dir)
    stats = C.unit_country_stats(C.paired_vectors(inp.item_scores, inp.truth_long, inp.weights, inp.units, inp.rules))
    return stats.select("scenario", "model", "unit_key", "country_id", "fact_mae", "stance_mae")


@register("wilcoxon_signed_rank", S.with_inputs(
    f"SELECT scenario, model, unit_key, country_id, CAST(fact_n AS BIGINT) AS fact_nonzero, {S.signed_rank_select('fact')}, "
    f"CAST(stance_n AS BIGINT) AS stance_nonzero, {S.signed_rank_select('stance')} FROM ustats", *S.comparison_inputs()))
def wilcoxon_signed_rank(spark, sf_dir):
    """Paired signed-rank test per (unit, country), normal approximation."""
    inp = Inputs.of(spark, sf_dir)
    paired = C.paired_vectors(inp.item_scores, inp.truth_long, inp.weights, inp.units, inp.rules)
    keys = U.UNIT + ["country_id"]
    ranked = C.with_average_rank(C.with_average_rank(paired, keys, "fact_d", "fact"), keys, "stance_d", "stance")
    return ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("fact_d") != 0, 1).otherwise(0)).alias("fact_nonzero"),
        *C.signed_rank_aggs("fact_d", "fact"),
        F.sum(F.when(F.col("stance_d") != 0, 1).otherwise(0)).alias("stance_nonzero"),
        *C.signed_rank_aggs("stance_d", "stance"))


@register("average_rank", S.with_inputs(
    "SELECT scenario, model, unit_key, country_id, item_id, fact_d, fact_rank, fact_tie FROM ranked",
    *S.comparison_inputs()))
def average_rank(spark, sf_dir):
    """Average rank with ties of |d| within each (unit, country), zeros apart."""
    inp = Inputs.of(spark, sf_dir)
    paired = C.paired_vectors(inp.item_scores, inp.truth_long, inp.weights, inp.units, inp.rules)
    keys = U.UNIT + ["country_id"]
    return (C.with_average_rank(paired, keys, "fact_d", "fact")
            .select(*keys, "item_id", "fact_d", "fact_rank", "fact_tie"))


@register("weighted_total", S.with_inputs(
    f"SELECT scenario, model, unit_key, {S.stable_py('sum(fact_w)', 2)} AS fact_total, "
    f"{S.stable_py('sum(stance_w)', 2)} AS stance_total, count(*) AS n_items FROM meter GROUP BY ALL",
    *S.comparison_inputs()))
def weighted_total(spark, sf_dir):
    """Weighted total (percentage score) per complete unit."""
    inp = Inputs.of(spark, sf_dir)
    return C.weighted_totals(inp.item_scores, inp.weights, inp.rules)


@register("truth_total", S.with_inputs(
    f"SELECT country_id, {S.stable_py('sum(score_w)', 2)} AS truth_total, count(*) AS n_items FROM truthv GROUP BY ALL",
    *S.comparison_inputs()))
def truth_total(spark, sf_dir):
    """Weighted total of the adjusted truth vector per country."""
    inp = Inputs.of(spark, sf_dir)
    t = C.truth_vectors(inp.truth_long, inp.weights, inp.rules)
    return t.groupBy("country_id").agg(C.stable_py_round(F.sum("score_w"), 2).alias("truth_total"),
                                       F.count(F.lit(1)).alias("n_items"))


def _items76(spark, sf_dir):
    return D.item_scores(spark, sf_dir, N76)


@register("completeness_gate", S.with_inputs(
    "SELECT scenario, model, unit_key, criterion_id, fact, support, opposition FROM m_gated",
    S.cte_item_scores(N76), S.cte_gate("m_gated", "item_scores", ["scenario", "model", "unit_key"], N76)))
def completeness_gate(spark, sf_dir):
    """Rows of units holding exactly the 76 criteria of the published questionnaire."""
    gated = U.completeness_gate(_items76(spark, sf_dir), N76)
    return gated.select("scenario", "model", "unit_key", "criterion_id", "fact", "support", "opposition")


_STATUS_SQL = f"""
SELECT e.scenario, e.model, e.unit_key, coalesce(c.n_rows, 0) AS n_rows,
       CASE WHEN c.n_rows IS NULL THEN 'missing'
            WHEN c.n_rows = {N76} AND c.n_criteria = {N76} THEN 'complete' ELSE 'incomplete' END AS status
FROM (SELECT DISTINCT scenario, model, unit_key FROM units) e
LEFT JOIN (SELECT scenario, model, unit_key, count(*) AS n_rows, count(DISTINCT criterion_id) AS n_criteria
           FROM item_scores GROUP BY ALL) c USING (scenario, model, unit_key)"""


@register("unit_status", S.with_inputs(_STATUS_SQL, *BASE(), S.cte_item_scores(N76)))
def unit_status(spark, sf_dir):
    """Gate diagnostics of every expected unit: complete / incomplete / missing."""
    inp = Inputs.of(spark, sf_dir)
    return U.unit_status(inp.units, _items76(spark, sf_dir), N76)


@register("pending_units", S.with_inputs(
    "SELECT DISTINCT scenario, model, unit_key FROM units ANTI JOIN "
    "(SELECT DISTINCT scenario, model, unit_key FROM m_gated) d USING (scenario, model, unit_key)",
    *BASE(), S.cte_item_scores(N76), S.cte_gate("m_gated", "item_scores", ["scenario", "model", "unit_key"], N76)))
def pending_units(spark, sf_dir):
    """Expected units still to be collected: anti join on the complete ones."""
    inp = Inputs.of(spark, sf_dir)
    return U.pending_units(inp.units, _items76(spark, sf_dir), N76)


@register("enumerate_units", S.with_inputs("SELECT * FROM units", *BASE()))
def enumerate_units(spark, sf_dir):
    """Scenario x model x (country, language of the country) work units."""
    return Inputs.of(spark, sf_dir).units


@register("scenario_key_join", S.with_inputs(
    f"SELECT u.scenario, u.model, u.unit_key, u.country_id, u.language, "
    f"{S.stable_py('sum(fact_w)', 2)} AS fact_total FROM meter m JOIN units u USING (scenario, model, unit_key) "
    f"GROUP BY ALL", *S.comparison_inputs()))
def scenario_key_join(spark, sf_dir):
    """Unit totals attached to every (country, language) the scenario key reaches."""
    inp = Inputs.of(spark, sf_dir)
    totals = C.weighted_totals(inp.item_scores, inp.weights, inp.rules).select(*U.UNIT, "fact_total")
    return (U.scenario_key_join(totals, inp.units.select(*U.UNIT, "country_id", "language"))
            .select(*U.UNIT, "country_id", "language", "fact_total"))


@register("stance_score", S.with_inputs(
    f"SELECT scenario, model, unit_key, criterion_id, {S.npr('(support + (1.0 - opposition)) / 2.0', 10)} AS stance, "
    f"stance AS stance_stored FROM item_scores", S.cte_item_scores()))
def stance_score(spark, sf_dir):
    """Stance from support and opposition, unrounded and as stored at collection."""
    it = Inputs.of(spark, sf_dir).item_scores
    return it.select(*U.UNIT, "criterion_id", np_round(A.stance_score(), 10).alias("stance"),
                     F.col("stance").alias("stance_stored"))


@register("prerequisite_gate", S.with_inputs(
    "SELECT scenario, model, unit_key, criterion_id, fact, stance FROM meter_g", *S.comparison_inputs()))
def prerequisite_gate(spark, sf_dir):
    """Gated criteria score 0 unless their prerequisite scores > 0 in the unit."""
    inp = Inputs.of(spark, sf_dir)
    gated = U.completeness_gate(inp.item_scores, TEST_RULES.n_criteria)
    scores = gated.select(*U.UNIT, "criterion_id", F.col("fact").cast("double").alias("fact"),
                          A.stance_score().alias("stance"))
    return A.prerequisite_gate(scores, U.UNIT, ["fact", "stance"], TEST_RULES)


_COLLAPSE_SQL = f"""
SELECT scenario, model, unit_key, item_id,
       max(fact) AS fact, first(weight ORDER BY fact DESC, criterion_id ASC) AS fact_weight,
       max(stance) AS stance, first(weight ORDER BY stance DESC, criterion_id ASC) AS stance_weight
FROM (SELECT g.*, w.weight, {S.item_id_sql(TEST_RULES)} AS item_id FROM meter_g g JOIN weights w USING (criterion_id))
GROUP BY ALL"""


@register("exclusive_group_collapse", S.with_inputs(_COLLAPSE_SQL, *S.comparison_inputs()))
def exclusive_group_collapse(spark, sf_dir):
    """Exclusive group -> one item with the max score and the weight of the lowest id at the max."""
    inp = Inputs.of(spark, sf_dir)
    gated = U.completeness_gate(inp.item_scores, TEST_RULES.n_criteria)
    scores = gated.select(*U.UNIT, "criterion_id", F.col("fact").cast("double").alias("fact"),
                          A.stance_score().alias("stance"))
    scores = A.prerequisite_gate(scores, U.UNIT, ["fact", "stance"], TEST_RULES)
    weighted = scores.join(inp.weights, "criterion_id")
    return A.exclusive_group_collapse(weighted, U.UNIT, ["fact", "stance"], TEST_RULES)


@register("unpivot_truth", S.with_inputs(
    "SELECT country_id, criterion_id, score FROM truth_long", S.cte_truth_long()))
def unpivot_truth(spark, sf_dir):
    """Wide truth (one column per criterion) to long rows."""
    return Inputs.of(spark, sf_dir).truth_long.where(F.col("score").isNotNull())


_LABEL_SQL = f"""
SELECT d.model, coalesce(m.label, d.model) AS label, m.ord
FROM (SELECT DISTINCT model FROM item_scores) d
LEFT JOIN (SELECT unnest({S.lst(R.MODEL_LIST)}) AS model,
                  unnest({S.lst([R.MODEL_LABEL[m] for m in R.MODEL_LIST])}) AS label,
                  CAST(unnest(range({len(R.MODEL_LIST)})) AS INTEGER) AS ord) m USING (model)"""


@register("label_map", S.with_inputs(_LABEL_SQL, S.cte_item_scores()))
def label_map(spark, sf_dir):
    """Display label per model with fallback to the raw name."""
    from probitas.operators.rollups import label_map as lm
    models = Inputs.of(spark, sf_dir).item_scores.select("model").distinct()
    return lm(models, R.model_dim(spark)).select("model", "label", "ord")


_ORDERED_SQL = f"""
SELECT m.label AS model, m.ord, count(*) AS n_rows
FROM comparison c JOIN (SELECT unnest({S.lst(R.MODEL_LIST)}) AS model,
                  unnest({S.lst([R.MODEL_LABEL[m] for m in R.MODEL_LIST])}) AS label,
                  CAST(unnest(range({len(R.MODEL_LIST)})) AS INTEGER) AS ord) m USING (model)
GROUP BY ALL"""


@register("ordered_models", S.with_inputs(_ORDERED_SQL, *S.comparison_inputs()))
def ordered_models(spark, sf_dir):
    """Comparison rows per model, in the fixed model order (O1)."""
    from probitas.operators.rollups import ordered_by_model
    comp = staged_comparison(spark, sf_dir)
    counted = comp.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    return ordered_by_model(counted, R.model_dim(spark)).select(F.col("label").alias("model"), "ord", "n_rows")
