"""Roll-ups of the comparison table along model / scenario / country / language,
and the matrix shapes the reports use. Everything is computed in long form and
pivoted last over an explicit, bounded value list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas import rules as R
from probitas.functions.numeric import np_round, stable_round
from probitas.operators.units import scenario_label_expr

TESTS = [("Fact", "fact"), ("Stance", "stance")]


def slug(name: str) -> str:
    """Column-safe name of a label ("Qwen 2B" -> "qwen_2b")."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def label_map(df: DataFrame, models: DataFrame, model_col: str = "model") -> DataFrame:
    """Attach (label, ord); unknown models keep their raw name as label."""
    # the model dimension is built from a bounded parameter list
    return (df.join(F.broadcast(models), df[model_col] == models["model"], "left")
            .drop(models["model"])
            .withColumn("label", F.coalesce(F.col("label"), F.col(model_col))))


def ordered_by_model(df: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of known models, in the fixed model order (O1)."""
    return df.join(F.broadcast(models), "model", "inner").orderBy("ord")


def _label_cols(df: DataFrame, models: DataFrame) -> DataFrame:
    return label_map(df, models).withColumnRenamed("label", "model_label")


def by_test(comp: DataFrame, keep: list[str]) -> DataFrame:
    """Fact and Stance side by side -> one row per (comparison row, test) with
    ``score``, ``mae`` and ``p``: every roll-up then aggregates once for both tests."""
    return comp.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(t).alias("test"), F.col(c).alias("score"), F.col(f"{c}_mae").alias("mae"),
                 F.col(f"{c}_pvalue").alias("p"))
        for t, c in TESTS])).alias("_t")).select(*keep, "_t.*")


# -- A9 ------------------------------------------------------------------------------------------
def model_mae_summary(comp: DataFrame, models: DataFrame) -> DataFrame:
    """Per test and model: "<mae> <pct>\\%" per scenario and on average.

    Scenario MAE = mean of the unit MAEs (2 dp); pct = share of rows whose rounded
    p-value is below 0.05. Average = mean of the *rounded* scenario MAEs and the
    pooled share. A missing scenario shows "-". The scenario cells and the
    average come out of one aggregation (conditional aggregates = the pivot).
    """
    per = by_test(comp, ["model", "scenario"]).groupBy("test", "model", "scenario").agg(
        stable_round(F.avg("mae"), 2).alias("mae"),
        F.sum(F.when(F.col("p") < R.SIGNIFICANCE_LEVEL, 1).otherwise(0)).alias("sig"),
        F.count(F.lit(1)).alias("n"))

    def cell(mae, sig, n):
        return F.concat(mae.cast("string"), F.lit(" "), np_round(sig / n * 100, 0).cast("string"), F.lit("\\%"))

    out = per.groupBy("test", "model").agg(
        *[F.coalesce(F.first(F.when(F.col("scenario") == s, cell(F.col("mae"), F.col("sig"), F.col("n"))),
                             ignorenulls=True), F.lit("-")).alias(s) for s in R.SCENARIOS],
        cell(stable_round(F.avg("mae"), 2), F.sum("sig"), F.sum("n")).alias("average"))
    return ordered_by_model(out, models).select("test", F.col("label").alias("model"), "ord", *R.SCENARIOS, "average")


# -- A10 -----------------------------------------------------------------------------------------
def model_scenario_percentage(comp: DataFrame, models: DataFrame) -> DataFrame:
    """Per model: mean fact / stance per scenario rounded to integers, and the
    mean of those rounded integers (rounded again)."""
    per = (_label_cols(comp, models)
           .groupBy("model_label", "scenario")
           .agg(np_round(stable_round(F.avg("fact"), 6), 0).alias("fact"),
                np_round(stable_round(F.avg("stance"), 6), 0).alias("stance")))
    cells = [F.first(F.when(F.col("scenario") == s, F.col(m)), ignorenulls=True).cast("bigint").alias(f"{s}_{m}")
             for s in R.SCENARIOS for m in ("fact", "stance")]
    return (per.groupBy("model_label")
            .agg(*cells, np_round(stable_round(F.avg("fact"), 6), 0).cast("bigint").alias("fact_average"),
                 np_round(stable_round(F.avg("stance"), 6), 0).cast("bigint").alias("stance_average"))
            .withColumnRenamed("model_label", "model"))


# -- A11 / A12 -----------------------------------------------------------------------------------
def _scenario_means(comp: DataFrame, scenario: str, keys: list[str]) -> DataFrame:
    return (comp.where(F.col("scenario") == scenario).groupBy(*keys)
            .agg(F.avg("fact_mae").alias("fact_mae"), F.avg("stance_mae").alias("stance_mae")))


def scenario_country_mae(comp: DataFrame) -> DataFrame:
    """(language, country) x scenario MAE matrix, 6 measures, 2 dp.

    Language-scenario means reach every country of the language and country
    means every language of the country through the distinct (language, country)
    bridge of the whole table (J9); the three legs are then full-outer joined (J8).
    """
    bridge = comp.select("language", "country").distinct()
    lang = _scenario_means(comp, R.SCENARIO_LANGUAGE, ["language"]).join(bridge, "language", "left")
    ctry = _scenario_means(comp, R.SCENARIO_COUNTRY, ["country"]).join(bridge, "country", "left")
    pair = _scenario_means(comp, R.SCENARIO_LANGUAGE_COUNTRY, ["language", "country"])

    def leg(df, s):
        return df.select("language", "country", F.col("fact_mae").alias(f"{s}_fact_mae"),
                         F.col("stance_mae").alias(f"{s}_stance_mae"))

    merged = (leg(lang, R.SCENARIO_LANGUAGE)
              .join(leg(ctry, R.SCENARIO_COUNTRY), ["language", "country"], "full")
              .join(leg(pair, R.SCENARIO_LANGUAGE_COUNTRY), ["language", "country"], "full"))
    measures = [f"{s}_{m}_mae" for s in R.SCENARIOS for m in ("fact", "stance")]
    return merged.select("language", "country", *[stable_round(F.col(c), 2).alias(c) for c in measures])


def language_country_mae(comp: DataFrame) -> DataFrame:
    """Long (test, language, country, value): language scenario with country
    "No Country", country scenario with language "English", pairs as they are."""
    long = by_test(comp, ["scenario", "language", "country"])
    sc = F.col("scenario")
    lang = (long.where(sc == R.SCENARIO_LANGUAGE).groupBy("test", "language").agg(F.avg("mae").alias("value"))
            .select("test", "language", F.lit(R.NO_COUNTRY).alias("country"), "value"))
    ctry = (long.where(sc == R.SCENARIO_COUNTRY).groupBy("test", "country").agg(F.avg("mae").alias("value"))
            .select("test", F.lit(R.ENGLISH).alias("language"), "country", "value"))
    pair = (long.where(sc == R.SCENARIO_LANGUAGE_COUNTRY).groupBy("test", "language", "country")
            .agg(F.avg("mae").alias("value")))
    return (lang.unionByName(ctry).unionByName(pair.select("test", "language", "country", "value"))
            .withColumn("value", stable_round(F.col("value"), 2)))


# -- A13 / A14 / R1 / R4 ---------------------------------------------------------------------------
def country_model_percentage_long(comp: DataFrame, models: DataFrame) -> DataFrame:
    """Long (test, country, model, truth, value): integer-rounded means of the
    score per (country, model) and of the truth per country."""
    per = (by_test(_label_cols(comp, models), ["country", "model_label"])
           .groupBy("test", "country", "model_label")
           .agg(np_round(stable_round(F.avg("score"), 6), 0).cast("bigint").alias("value")))
    truth = comp.groupBy("country").agg(np_round(stable_round(F.avg("truth"), 6), 0).cast("bigint").alias("truth"))
    return (per.join(truth, "country", "inner")
            .select("test", "country", F.col("model_label").alias("model"), "truth", "value"))


def country_model_percentage(comp: DataFrame, models: DataFrame, model_labels: list[str]) -> DataFrame:
    """Country x model matrix (test, country, truth, <model label>...)."""
    long = country_model_percentage_long(comp, models)
    truth = long.select("test", "country", "truth").distinct()
    wide = long.groupBy("test", "country").pivot("model", model_labels).agg(F.first("value"))
    wide = wide.select("test", "country", *[F.col(f"`{m}`").alias(slug(m)) for m in model_labels])
    return truth.join(wide, ["test", "country"], "left")


def model_country_distance(comp: DataFrame, models: DataFrame) -> DataFrame:
    """Long (test, model, country, distance): model score - truth, both integers."""
    return distances(country_model_percentage_long(comp, models))


def distances(long: DataFrame) -> DataFrame:
    """(test, country, model, truth, value) -> (test, model, country, distance = value - truth)."""
    return long.select("test", "model", "country", (F.col("value") - F.col("truth")).alias("distance"))


def mean_distance(dist: DataFrame, drop_last_country: bool = False, digits: int = 4) -> DataFrame:
    """Mean signed distance per (test, model); ``drop_last_country`` leaves out the
    alphabetically last country, as the published tables do (A14)."""
    if drop_last_country:
        last = dist.agg(F.max("country").alias("_last"))
        # one-row aggregate: broadcast is bounded by construction
        dist = dist.join(F.broadcast(last), F.col("country") == F.col("_last"), "left_anti")
    return dist.groupBy("test", "model").agg(stable_round(F.avg("distance"), digits).alias("avg_distance"))


def avg_distance(comp: DataFrame, models: DataFrame, drop_last_country: bool = False) -> DataFrame:
    """Mean signed distance per (test, model) over the integer country tables."""
    return mean_distance(model_country_distance(comp, models), drop_last_country)


def distance_matrix(comp: DataFrame, models: DataFrame, countries: list[str]) -> DataFrame:
    """Model x country signed distance, plus its absolute copy."""
    dist = model_country_distance(comp, models)
    wide = dist.groupBy("test", "model").pivot("country", countries).agg(F.first("distance"))
    cols = [F.col(f"`{c}`").alias(slug(c)) for c in countries]
    abs_cols = [F.abs(F.col(f"`{c}`")).alias("abs_" + slug(c)) for c in countries]
    return wide.select("test", "model", *cols, *abs_cols)


# -- A5 / R2 -------------------------------------------------------------------------------------
METRICS = [("fact_coh", "fact_coherence"), ("fact_val", "fact_validity"), ("fact_coh_val", "fact_weighted"),
           ("stance_coh", "stance_coherence"), ("stance_val", "stance_validity"),
           ("stance_coh_val", "stance_weighted")]


def unit_metric_means(gated_items: DataFrame, units: DataFrame, models: DataFrame) -> DataFrame:
    """Long (scenario, metric, model, label, value): null-skipping mean of each
    response-quality metric per complete answer file, 2 dp, keyed by the unit label."""
    labels = units.select("scenario", "model", "unit_key",
                          scenario_label_expr(country_id="country_id").alias("label")).distinct()
    per_unit = gated_items.groupBy("scenario", "model", "unit_key").agg(
        *[F.avg(col).alias(m) for m, col in METRICS])
    joined = per_unit.join(labels, ["scenario", "model", "unit_key"], "inner")
    joined = joined.join(F.broadcast(models.select("model", "label").withColumnRenamed("label", "model_label")),
                         "model", "inner")
    stacked = joined.select("scenario", "model_label", "label", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, _ in METRICS])).alias("m"))
    return (stacked.groupBy("scenario", F.col("m.metric").alias("metric"), F.col("model_label").alias("model"), "label")
            .agg(stable_round(F.avg("m.value"), 2).alias("value")))


def metric_matrix(means: DataFrame, scenario: str, labels: list[str], fill: float | None = None) -> DataFrame:
    """Model x label matrix of one scenario, plus the row average of the rounded
    cells (2 dp) as ``average`` -- one aggregation (R2, A15). ``fill`` replaces
    missing cells after the average is taken (P13, as for drawing)."""
    one = means.where(F.col("scenario") == scenario)
    cells = [F.first(F.when(F.col("label") == l, F.col("value")), ignorenulls=True).alias(slug(l)) for l in labels]
    out = one.groupBy("metric", "model").agg(*cells, stable_round(F.avg("value"), 2).alias("average"))
    return out.fillna(fill, subset=[slug(l) for l in labels]) if fill is not None else out


# -- A17 / J8 / J10 / R3 / R5 --------------------------------------------------------------------
def truth_vs_mae(comp: DataFrame) -> DataFrame:
    """Per country: mean truth and mean fact / stance MAE, ordered by truth."""
    return (comp.groupBy("country")
            .agg(stable_round(F.avg("truth"), 4).alias("truth"), stable_round(F.avg("fact_mae"), 4).alias("fact_mae"),
                 stable_round(F.avg("stance_mae"), 4).alias("stance_mae"))
            .orderBy("truth"))


def scenario_country_series(sc_mae: DataFrame) -> DataFrame:
    """Per test, country-axis MAE series of the three scenarios.

    Language-scenario rows are averaged per country; country rows are distinct
    (country, value); pair rows stay as they are, and the report's full joins on
    country multiply them. Here that product comes from one aggregation per
    (test, country) -- the distinct country values and the pair values are
    bounded per country (one per language) -- followed by two ``explode_outer``.
    """
    cols = [f"{s}_{c}_mae" for s in R.SCENARIOS for _, c in TESTS]
    long = (sc_mae.unpivot(["language", "country"], cols, "measure", "mae").where(F.col("mae").isNotNull())
            .select("country", "mae",
                    F.when(F.col("measure").contains("_fact_"), F.lit("Fact")).otherwise(F.lit("Stance")).alias("test"),
                    F.regexp_extract("measure", "^(.*)_(fact|stance)_mae$", 1).alias("scenario")))
    sc = F.col("scenario")
    per = long.groupBy("test", "country").agg(
        F.avg(F.when(sc == R.SCENARIO_LANGUAGE, F.col("mae"))).alias("language_scenario_mae"),
        F.array_sort(F.collect_set(F.when(sc == R.SCENARIO_COUNTRY, F.col("mae")))).alias("_c"),
        F.collect_list(F.when(sc == R.SCENARIO_LANGUAGE_COUNTRY, F.col("mae"))).alias("_p"))
    rows = (per.select("test", "country", "language_scenario_mae", "_p",
                       F.explode_outer("_c").alias("country_scenario_mae"))
            .select("test", "country", "language_scenario_mae", "country_scenario_mae",
                    F.explode_outer("_p").alias("language_country_scenario_mae")))
    return rows.select("test", "country",
                       stable_round(F.col("country_scenario_mae"), 4).alias("country_scenario_mae"),
                       stable_round(F.col("language_scenario_mae"), 4).alias("language_scenario_mae"),
                       "language_country_scenario_mae")


def percentage_series(comp: DataFrame) -> DataFrame:
    """Per test, (country, language) series of the three scenarios and the truth."""
    long = by_test(comp, ["scenario", "country", "language", "truth"])
    sc = F.col("scenario")
    lang = (long.where(sc == R.SCENARIO_LANGUAGE).groupBy("test", "country", "language")
            .agg(F.avg("score").alias("language_scenario_per")))
    ctry = (long.where(sc == R.SCENARIO_COUNTRY).groupBy("test", "country")
            .agg(F.avg("score").alias("country_scenario_per")))
    pair = (long.where(sc == R.SCENARIO_LANGUAGE_COUNTRY).groupBy("test", "country", "language")
            .agg(F.avg("score").alias("language_country_scenario_per")))
    truth = comp.groupBy("country", "language").agg(F.avg("truth").alias("truth_score"))
    merged = (lang.join(ctry, ["test", "country"], "left").join(pair, ["test", "country", "language"], "left")
              .join(truth, ["country", "language"], "left"))
    return (merged.select("test", "country", "language",
                          *[stable_round(F.col(x), 4).alias(x) for x in
                            ("language_scenario_per", "country_scenario_per",
                             "language_country_scenario_per", "truth_score")])
            .orderBy("test", "truth_score"))


def x_label_expr() -> Column:
    s = F.col("scenario")
    return (F.when(s == R.SCENARIO_LANGUAGE, F.col("language"))
            .when(s == R.SCENARIO_COUNTRY, F.col("country"))
            .otherwise(F.concat_ws(" | ", F.col("language"), F.col("country"))))


def model_label_mae(comp: DataFrame, models: DataFrame) -> DataFrame:
    """Long (test, scenario, model, x_label, mae): mean MAE per model and axis label."""
    per = (by_test(comp.withColumn("x_label", x_label_expr()), ["scenario", "model", "x_label"])
           .groupBy("test", "scenario", "model", "x_label").agg(F.avg("mae").alias("mae")))
    return (ordered_by_model(per, models)
            .select("test", "scenario", F.col("label").alias("model"), "ord", "x_label",
                    stable_round(F.col("mae"), 4).alias("mae")))


def language_country_matrix(lc_mae: DataFrame, countries: list[str]) -> DataFrame:
    """Language x country matrix of the long MAE table: mean, 2 dp, x100; the
    "No Country" column and the "English" row first (R5, O4)."""
    cols = [R.NO_COUNTRY] + sorted(c for c in countries if c != R.NO_COUNTRY)
    wide = (lc_mae.groupBy("test", "language").pivot("country", cols)
            .agg((stable_round(F.avg("value"), 2) * 100).alias("v")))
    return (wide.select("test", "language", *[F.col(f"`{c}`").alias(slug(c)) for c in cols])
            .orderBy("test", F.when(F.col("language") == R.ENGLISH, 0).otherwise(1), "language"))
