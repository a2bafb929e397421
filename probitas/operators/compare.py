"""Comparison with the truth vector: weighted totals, MAE, paired signed-rank test,
and the per-(model, scenario, country, language) comparison table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.functions.numeric import np_round, stable_py_round, stable_round, two_sided_normal_p
from probitas.operators.adjust import adjusted_weighted, stance_score
from probitas.operators.units import UNIT, completeness_gate
from probitas.rules import AuditRules

# |d| is snapped to this many decimals before ranking, so float noise cannot
# break ties differently in different engines.
RANK_DECIMALS = 10


def with_average_rank(df: DataFrame, keys: list[str], d_col: str, prefix: str) -> DataFrame:
    """Average rank (ties share the mean rank) of |d| among the non-zero d of each group.

    Adds ``<prefix>_rank`` and ``<prefix>_tie`` (size of the tie block). Groups are
    units of bounded size; the windows share one partitioning by ``keys``.
    """
    d = F.col(d_col)
    absd = F.abs(d)
    nonzero = d != 0
    w_order = Window.partitionBy(*keys, nonzero).orderBy(absd)
    w_tie = Window.partitionBy(*keys, nonzero, absd)
    tie = F.count(F.lit(1)).over(w_tie)
    return (df.withColumn(f"{prefix}_tie", tie)
            .withColumn(f"{prefix}_rank", F.rank().over(w_order) + (F.col(f"{prefix}_tie") - 1) / F.lit(2.0)))


def signed_rank_aggs(d_col: str, prefix: str) -> list[Column]:
    """Wilcoxon signed-rank (zeros dropped, normal approximation, no continuity
    correction, two-sided) as aggregate expressions over rows carrying
    ``with_average_rank`` columns. Returns ``<prefix>_stat`` and ``<prefix>_pvalue``."""
    d = F.col(d_col)
    rank = F.col(f"{prefix}_rank")
    tie = F.col(f"{prefix}_tie")
    n = F.sum(F.when(d != 0, 1).otherwise(0))
    r_plus = F.coalesce(F.sum(F.when(d > 0, rank)), F.lit(0.0))
    r_minus = F.coalesce(F.sum(F.when(d < 0, rank)), F.lit(0.0))
    tie_term = F.coalesce(F.sum(F.when(d != 0, tie * tie - 1)), F.lit(0)).cast("double")
    var = n * (n + 1) * (2 * n + 1) / F.lit(24.0) - tie_term / F.lit(48.0)
    z = (r_plus - n * (n + 1) / F.lit(4.0)) / F.sqrt(var)
    p = F.when((n > 0) & (var > 0), two_sided_normal_p(z))
    return [np_round(F.least(r_plus, r_minus), 2).alias(f"{prefix}_stat"),
            np_round(p, 2).alias(f"{prefix}_pvalue")]


def truth_vectors(truth_long: DataFrame, weights: DataFrame, rules: AuditRules) -> DataFrame:
    """Adjusted, weighted truth per (country_id, item_id) -> ``score_w``.

    Only countries with a complete truth vector take part.
    """
    complete = completeness_gate(truth_long.where(F.col("score").isNotNull()), rules.n_criteria, ["country_id"])
    return adjusted_weighted(complete, ["country_id"], ["score"], weights, rules)


def countries_without_truth(units: DataFrame, truth_long: DataFrame, rules: AuditRules) -> DataFrame:
    """Countries the units ask for that have no complete truth vector (J4, strict lookup)."""
    complete = completeness_gate(truth_long.where(F.col("score").isNotNull()), rules.n_criteria, ["country_id"])
    return units.select("country_id").distinct().join(complete.select("country_id").distinct(), "country_id",
                                                      "left_anti")


def meter_vectors(item_scores: DataFrame, weights: DataFrame, rules: AuditRules) -> DataFrame:
    """Adjusted, weighted fact and stance per (unit, item_id), for complete units.

    Each unit is scored once here, before the fan-out to countries.
    """
    gated = completeness_gate(item_scores, rules.n_criteria)
    scores = gated.select(*UNIT, "criterion_id", F.col("fact").cast("double").alias("fact"),
                          stance_score("support", "opposition").alias("stance"))
    return adjusted_weighted(scores, UNIT, ["fact", "stance"], weights, rules)


def paired_vectors(item_scores: DataFrame, truth_long: DataFrame, weights: DataFrame, units: DataFrame,
                   rules: AuditRules) -> DataFrame:
    """Meter and truth items side by side for every (unit, country) pair the units
    table asks for, with the differences snapped for ranking."""
    meter = meter_vectors(item_scores, weights, rules)
    truth = truth_vectors(truth_long, weights, rules)
    links = units.select("scenario", "model", "unit_key", "country_id").distinct()
    paired = (meter.join(links, UNIT, "inner")
              .join(truth, ["country_id", "item_id"], "inner"))
    return (paired
            .withColumn("fact_d", np_round(F.col("fact_w") - F.col("score_w"), RANK_DECIMALS))
            .withColumn("stance_d", np_round(F.col("stance_w") - F.col("score_w"), RANK_DECIMALS)))


def unit_country_stats(paired: DataFrame) -> DataFrame:
    """Per (unit, country): weighted totals, MAE and signed-rank test for fact and stance."""
    keys = UNIT + ["country_id"]
    ranked = with_average_rank(with_average_rank(paired, keys, "fact_d", "fact"), keys, "stance_d", "stance")
    return ranked.groupBy(*keys).agg(
        stable_py_round(F.sum("fact_w"), 2).alias("fact"),
        stable_py_round(F.sum("stance_w"), 2).alias("stance"),
        stable_py_round(F.sum("score_w"), 2).alias("truth"),
        *signed_rank_aggs("fact_d", "fact"),
        stable_round(F.avg(F.abs(F.col("score_w") - F.col("fact_w"))), 2).alias("fact_mae"),
        *signed_rank_aggs("stance_d", "stance"),
        stable_round(F.avg(F.abs(F.col("score_w") - F.col("stance_w"))), 2).alias("stance_mae"),
    )


COMPARISON_COLUMNS = ["scenario", "model", "unit_key", "country_id", "country", "language", "language_code",
                      "fact", "stance", "truth", "fact_stat", "fact_pvalue", "fact_mae",
                      "stance_stat", "stance_pvalue", "stance_mae"]


def comparison_table(item_scores: DataFrame, truth_long: DataFrame, weights: DataFrame, units: DataFrame,
                     rules: AuditRules) -> DataFrame:
    """One row per (model, scenario, country, language of the country) with a
    complete unit: totals, MAE and signed-rank statistics for fact and stance.

    The statistics are computed once per (unit, country) and only then fanned
    out to the country's languages.
    """
    stats = unit_country_stats(paired_vectors(item_scores, truth_long, weights, units, rules))
    rows = units.select("scenario", "model", "unit_key", "country_id", "country", "language", "language_code")
    return stats.join(rows, UNIT + ["country_id"], "inner").select(*COMPARISON_COLUMNS)


def weighted_totals(item_scores: DataFrame, weights: DataFrame, rules: AuditRules) -> DataFrame:
    """Weighted total (percentage score) of fact and stance per complete unit."""
    meter = meter_vectors(item_scores, weights, rules)
    return meter.groupBy(*UNIT).agg(stable_py_round(F.sum("fact_w"), 2).alias("fact_total"),
                                    stable_py_round(F.sum("stance_w"), 2).alias("stance_total"),
                                    F.count(F.lit(1)).alias("n_items"))
