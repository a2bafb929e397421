"""Registered roll-up queries over the staged comparison table (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probitas import rules as R
from probitas.operators import matrix as M
from probitas.operators import rollups as RU
from probitas.operators.units import completeness_gate
from probitas.plans import sql_inputs as S
from probitas.plans.inputs import Inputs, staged_comparison
from probitas.plans.registry import register
from probitas.session import materialize, stage_path
from probitas.sources import driver_tables as D
from probitas.sources import io as IO

LABELS = [R.MODEL_LABEL[m] for m in R.MODEL_LIST]
COUNTRIES = sorted(c[1] for c in D.COUNTRY_FIXTURE)
MODEL_DIM_SQL = (f"(SELECT unnest({S.lst(R.MODEL_LIST)}) AS model, unnest({S.lst(LABELS)}) AS label, "
                 f"CAST(unnest(range({len(R.MODEL_LIST)})) AS INTEGER) AS ord)")


def comp_sql(body: str, *extra: str) -> str:
    return S.with_inputs(body, *S.comparison_inputs(), *extra)


def s2(e):
    return S.stable(e, 2)


def int_round(e):
    return S.npr(S.stable(e, 6), 0)


LONG_TESTS_SQL = """long_t AS (
  SELECT model, scenario, 'Fact' AS test, fact_mae AS mae, fact_pvalue AS p FROM comparison
  UNION ALL SELECT model, scenario, 'Stance' AS test, stance_mae AS mae, stance_pvalue AS p FROM comparison),
per_t AS (
  SELECT test, model, scenario, {mae} AS mae, sum(CASE WHEN p < {sig} THEN 1 ELSE 0 END) AS sig, count(*) AS n
  FROM long_t GROUP BY ALL)""".format(mae=s2("avg(mae)"), sig=R.SIGNIFICANCE_LEVEL)


def _cell(mae, sig, n):
    return f"CAST({mae} AS VARCHAR) || ' ' || CAST({S.npr(f'{sig} / {n} * 100', 0)} AS VARCHAR) || '\\%'"


_MAE_SUMMARY_SQL = comp_sql(f"""
SELECT p.test, m.label AS model, m.ord,
       {', '.join(f"coalesce(max(CASE WHEN scenario = {S.q(s)} THEN {_cell('mae', 'sig', 'n')} END), '-') AS {s}"
                  for s in R.SCENARIOS)},
       CAST({s2('avg(mae)')} AS VARCHAR) || ' ' || CAST({S.npr('sum(sig) / sum(n) * 100', 0)} AS VARCHAR) || '\\%'
         AS average
FROM per_t p JOIN {MODEL_DIM_SQL} m USING (model)
GROUP BY p.test, m.label, m.ord""", LONG_TESTS_SQL)


@register("model_mae_summary", _MAE_SUMMARY_SQL)
def model_mae_summary(spark, sf_dir):
    """Per model and scenario: mean MAE and share of significant rows, plus average."""
    return RU.model_mae_summary(staged_comparison(spark, sf_dir), R.model_dim(spark))


_PCT_SQL = comp_sql(f"""
SELECT model, {', '.join(f"CAST(max(CASE WHEN scenario = {S.q(s)} THEN {m} END) AS BIGINT) AS {s}_{m}"
                         for s in R.SCENARIOS for m in ('fact', 'stance'))},
       CAST({int_round('avg(fact)')} AS BIGINT) AS fact_average,
       CAST({int_round('avg(stance)')} AS BIGINT) AS stance_average
FROM (SELECT coalesce(m.label, c.model) AS model, c.scenario,
             {int_round('avg(c.fact)')} AS fact, {int_round('avg(c.stance)')} AS stance
      FROM comparison c LEFT JOIN {MODEL_DIM_SQL} m USING (model) GROUP BY ALL)
GROUP BY model""")


@register("model_scenario_percentage", _PCT_SQL)
def model_scenario_percentage(spark, sf_dir):
    """Per model: integer mean fact / stance per scenario and mean of those (A10)."""
    return RU.model_scenario_percentage(staged_comparison(spark, sf_dir), R.model_dim(spark))


def _means(scenario, keys):
    return (f"SELECT {keys}, avg(fact_mae) AS fm, avg(stance_mae) AS sm FROM comparison "
            f"WHERE scenario = {S.q(scenario)} GROUP BY {keys}")


_SC_MAE_CTE = f"""bridge AS (SELECT DISTINCT language, country FROM comparison),
leg_l AS (SELECT b.language, b.country, m.fm AS language_scenario_fact_mae, m.sm AS language_scenario_stance_mae
          FROM ({_means(R.SCENARIO_LANGUAGE, 'language')}) m LEFT JOIN bridge b USING (language)),
leg_c AS (SELECT b.language, b.country, m.fm AS country_scenario_fact_mae, m.sm AS country_scenario_stance_mae
          FROM ({_means(R.SCENARIO_COUNTRY, 'country')}) m LEFT JOIN bridge b USING (country)),
leg_p AS (SELECT language, country, fm AS language_country_scenario_fact_mae,
                 sm AS language_country_scenario_stance_mae
          FROM ({_means(R.SCENARIO_LANGUAGE_COUNTRY, 'language, country')})),
sc_mae AS (
  SELECT language, country,
         {', '.join(f"{s2(f'{s}_{m}_mae')} AS {s}_{m}_mae" for s in R.SCENARIOS for m in ('fact', 'stance'))}
  FROM leg_l FULL JOIN leg_c USING (language, country) FULL JOIN leg_p USING (language, country))"""


@register("scenario_country_mae", comp_sql("SELECT * FROM sc_mae", _SC_MAE_CTE))
def scenario_country_mae(spark, sf_dir):
    """(language, country) x scenario MAE matrix through the distinct pair bridge."""
    return RU.scenario_country_mae(staged_comparison(spark, sf_dir))


_LC_MAE_CTE = "lc_mae AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS test, {lang} AS language, {ctry} AS country, {s2(f'avg({c}_mae)')} AS value "
    f"FROM comparison WHERE scenario = {S.q(s)} GROUP BY {grp}"
    for t, c in RU.TESTS
    for s, lang, ctry, grp in [(R.SCENARIO_LANGUAGE, "language", S.q(R.NO_COUNTRY), "language"),
                               (R.SCENARIO_COUNTRY, S.q(R.ENGLISH), "country", "country"),
                               (R.SCENARIO_LANGUAGE_COUNTRY, "language", "country", "language, country")]) + ")"


@register("language_country_mae", comp_sql("SELECT * FROM lc_mae", _LC_MAE_CTE))
def language_country_mae(spark, sf_dir):
    """Long language/country MAE with "No Country" / "English" placeholders."""
    return RU.language_country_mae(staged_comparison(spark, sf_dir))


_CMP_LONG_CTE = "cmp_long AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS test, p.country, p.model, t.truth, p.value FROM
  (SELECT c.country, coalesce(m.label, c.model) AS model, CAST({int_round(f'avg(c.{c})')} AS BIGINT) AS value
   FROM comparison c LEFT JOIN {MODEL_DIM_SQL} m USING (model) GROUP BY ALL) p
  JOIN (SELECT country, CAST({int_round('avg(truth)')} AS BIGINT) AS truth FROM comparison GROUP BY country) t
  USING (country)""" for t, c in RU.TESTS) + ")"

_CMP_WIDE_SQL = comp_sql(f"""
SELECT test, country, truth, {', '.join(f"max(CASE WHEN model = {S.q(l)} THEN value END) AS {RU.slug(l)}"
                                       for l in LABELS)}
FROM cmp_long GROUP BY test, country, truth""", _CMP_LONG_CTE)


@register("country_model_percentage", _CMP_WIDE_SQL)
def country_model_percentage(spark, sf_dir):
    """Country x model integer mean score, with the truth mean."""
    return RU.country_model_percentage(staged_comparison(spark, sf_dir), R.model_dim(spark), LABELS)


_DIST_CTE = "dist AS (SELECT test, model, country, value - truth AS distance FROM cmp_long)"


@register("reference_distance", comp_sql("SELECT * FROM dist", _CMP_LONG_CTE, _DIST_CTE))
def reference_distance(spark, sf_dir):
    """Signed distance model - truth per country, on the integer tables."""
    return RU.model_country_distance(staged_comparison(spark, sf_dir), R.model_dim(spark))


@register("avg_distance", comp_sql(
    f"SELECT test, model, {S.stable('avg(distance)', 4)} AS avg_distance FROM dist GROUP BY ALL",
    _CMP_LONG_CTE, _DIST_CTE))
def avg_distance(spark, sf_dir):
    """Mean signed distance per model over all countries."""
    return RU.avg_distance(staged_comparison(spark, sf_dir), R.model_dim(spark))


@register("avg_distance_compat", comp_sql(
    f"SELECT test, model, {S.stable('avg(distance)', 4)} AS avg_distance FROM dist "
    f"WHERE country <> (SELECT max(country) FROM comparison) GROUP BY ALL", _CMP_LONG_CTE, _DIST_CTE))
def avg_distance_compat(spark, sf_dir):
    """Mean signed distance leaving out the alphabetically last country, as published."""
    return RU.avg_distance(staged_comparison(spark, sf_dir), R.model_dim(spark), drop_last_country=True)


_DIST_MATRIX_SQL = comp_sql(f"""
SELECT test, model,
       {', '.join(f"max(CASE WHEN country = {S.q(c)} THEN distance END) AS {RU.slug(c)}" for c in COUNTRIES)},
       {', '.join(f"abs(max(CASE WHEN country = {S.q(c)} THEN distance END)) AS abs_{RU.slug(c)}" for c in COUNTRIES)}
FROM dist GROUP BY test, model""", _CMP_LONG_CTE, _DIST_CTE)


@register("distance_matrix", _DIST_MATRIX_SQL)
def distance_matrix(spark, sf_dir):
    """Model x country signed distance and its absolute copy."""
    return RU.distance_matrix(staged_comparison(spark, sf_dir), R.model_dim(spark), COUNTRIES)


@register("read_matrix", f"SELECT * EXCLUDE (test) FROM ({_DIST_MATRIX_SQL}) WHERE test = 'Fact'")
def read_matrix(spark, sf_dir):
    """The distance matrix of one test as a comma-delimited matrix file, read back by its row labels."""
    path = stage_path(spark, "matrix")
    wide = RU.distance_matrix(staged_comparison(spark, sf_dir), R.model_dim(spark), COUNTRIES).where("test = 'Fact'").drop("test")
    IO.write_delimited(wide, path, sep=",")
    back = IO.read_matrix(spark, path)
    return back.select("model", *[F.col(c).cast(wide.schema[c].dataType).alias(c) for c in wide.columns if c != "model"])


def _label_sql():
    return (f"CASE WHEN u.scenario = {S.q(R.SCENARIO_LANGUAGE)} THEN u.language "
            f"WHEN u.scenario = {S.q(R.SCENARIO_COUNTRY)} THEN u.country "
            f"ELSE concat_ws(' - ', u.language, u.country_id) END")


_METRIC_CTE = f"""unit_means AS (
  SELECT scenario, model, unit_key, {', '.join(f'avg({col}) AS {m}' for m, col in RU.METRICS)}
  FROM m_gated GROUP BY ALL),
labelled AS (
  SELECT x.*, l.label, md.label AS model_label FROM unit_means x
  JOIN (SELECT DISTINCT u.scenario, u.model, u.unit_key, {_label_sql()} AS label FROM units u) l
    USING (scenario, model, unit_key)
  JOIN {MODEL_DIM_SQL} md USING (model)),
metric_means AS (
  SELECT scenario, metric, model_label AS model, label, {s2('avg(value)')} AS value FROM (
    {' UNION ALL '.join(f"SELECT scenario, {S.q(m)} AS metric, model_label, label, {m} AS value FROM labelled"
                        for m, _ in RU.METRICS)})
  GROUP BY ALL)"""


def _gated_items(spark, sf_dir):
    inp = Inputs.of(spark, sf_dir)
    return completeness_gate(inp.item_scores, inp.rules.n_criteria)


@register("unit_metric_means", comp_sql("SELECT * FROM metric_means", _METRIC_CTE))
def unit_metric_means(spark, sf_dir):
    """Null-skipping means of the six response-quality metrics per answer file and label (A5, P10)."""
    inp = Inputs.of(spark, sf_dir)
    return RU.unit_metric_means(_gated_items(spark, sf_dir), inp.units, R.model_dim(spark))


_MATRIX_SQL = comp_sql(f"""
SELECT metric, model,
       {', '.join(f"max(CASE WHEN label = {S.q(c)} THEN value END) AS {RU.slug(c)}" for c in COUNTRIES)},
       {s2('avg(value)')} AS average
FROM metric_means WHERE scenario = {S.q(R.SCENARIO_COUNTRY)} GROUP BY metric, model""", _METRIC_CTE)


@register("metric_matrix", _MATRIX_SQL)
def metric_matrix(spark, sf_dir):
    """Model x country matrix of each metric in the country scenario, with row average."""
    inp = Inputs.of(spark, sf_dir)
    means = RU.unit_metric_means(_gated_items(spark, sf_dir), inp.units, R.model_dim(spark))
    return RU.metric_matrix(means, R.SCENARIO_COUNTRY, COUNTRIES)


@register("metric_matrix_filled", "SELECT metric, model, average, " + ", ".join(f"coalesce({RU.slug(c)}, 0.0) AS {RU.slug(c)}" for c in COUNTRIES)
          + f" FROM ({_MATRIX_SQL})")
def metric_matrix_filled(spark, sf_dir):
    """The metric matrix as it is drawn: missing cells are 0, the row average is that of the cells that are there."""
    inp = Inputs.of(spark, sf_dir)
    means = RU.unit_metric_means(_gated_items(spark, sf_dir), inp.units, R.model_dim(spark))
    return RU.metric_matrix(means, R.SCENARIO_COUNTRY, COUNTRIES, fill=0.0)


_BLOCK_WIDTH = 4


@register("metric_matrix_blocks", comp_sql(f"""
SELECT scenario, metric, model, CAST(n // {_BLOCK_WIDTH} AS INTEGER) AS block, CAST(n % {_BLOCK_WIDTH} AS INTEGER) AS place, name, value
FROM (SELECT DISTINCT scenario, metric, model FROM metric_means) r
CROSS JOIN (SELECT label AS name, row_number() OVER (ORDER BY encode(label)) - 1 AS n FROM (SELECT DISTINCT label FROM metric_means))
LEFT JOIN (SELECT scenario, metric, model, label AS name, value FROM metric_means) USING (scenario, metric, model, name)""", _METRIC_CTE))
def metric_matrix_blocks(spark, sf_dir):
    """The metric matrices of all scenarios over all labels, in blocks of columns; no list of labels on the driver (R2)."""
    inp = Inputs.of(spark, sf_dir)
    means = materialize(RU.unit_metric_means(_gated_items(spark, sf_dir), inp.units, R.model_dim(spark)), "unit-metric-means")
    rows, columns = ["scenario", "metric", "model"], M.block_columns(means, "label", _BLOCK_WIDTH)
    return M.block_cells(M.column_blocks(means, columns, rows, "label", "value", _BLOCK_WIDTH), columns, rows)


@register("truth_vs_mae", comp_sql(
    f"SELECT country, {S.stable('avg(truth)', 4)} AS truth, {S.stable('avg(fact_mae)', 4)} AS fact_mae, "
    f"{S.stable('avg(stance_mae)', 4)} AS stance_mae FROM comparison GROUP BY country"))
def truth_vs_mae(spark, sf_dir):
    """Mean truth and mean MAE per country, ordered by truth."""
    return RU.truth_vs_mae(staged_comparison(spark, sf_dir))


_SERIES_SQL = comp_sql(" UNION ALL ".join(f"""
SELECT '{t}' AS test, country, {S.stable('country_scenario_mae', 4)} AS country_scenario_mae,
       {S.stable('language_scenario_mae', 4)} AS language_scenario_mae, language_country_scenario_mae
FROM (SELECT DISTINCT country, {R.SCENARIO_COUNTRY}_{c}_mae AS country_scenario_mae FROM sc_mae
      WHERE {R.SCENARIO_COUNTRY}_{c}_mae IS NOT NULL) cc
FULL JOIN (SELECT country, avg({R.SCENARIO_LANGUAGE}_{c}_mae) AS language_scenario_mae FROM sc_mae
           WHERE {R.SCENARIO_LANGUAGE}_{c}_mae IS NOT NULL GROUP BY country) ll USING (country)
FULL JOIN (SELECT country, {R.SCENARIO_LANGUAGE_COUNTRY}_{c}_mae AS language_country_scenario_mae FROM sc_mae
           WHERE {R.SCENARIO_LANGUAGE_COUNTRY}_{c}_mae IS NOT NULL) pp USING (country)""" for t, c in RU.TESTS),
    _SC_MAE_CTE)


@register("scenario_country_series", _SERIES_SQL)
def scenario_country_series(spark, sf_dir):
    """Country-axis MAE series of the three scenarios, many-to-many full joins kept."""
    return RU.scenario_country_series(RU.scenario_country_mae(staged_comparison(spark, sf_dir)))


_PSERIES_SQL = comp_sql(" UNION ALL ".join(f"""
SELECT '{t}' AS test, country, language,
       {', '.join(S.stable(x, 4) + ' AS ' + x for x in ('language_scenario_per', 'country_scenario_per',
                                                          'language_country_scenario_per', 'truth_score'))}
FROM (SELECT country, language, avg({c}) AS language_scenario_per FROM comparison
      WHERE scenario = {S.q(R.SCENARIO_LANGUAGE)} GROUP BY ALL) l
LEFT JOIN (SELECT country, avg({c}) AS country_scenario_per FROM comparison
           WHERE scenario = {S.q(R.SCENARIO_COUNTRY)} GROUP BY ALL) cc USING (country)
LEFT JOIN (SELECT country, language, avg({c}) AS language_country_scenario_per FROM comparison
           WHERE scenario = {S.q(R.SCENARIO_LANGUAGE_COUNTRY)} GROUP BY ALL) p USING (country, language)
LEFT JOIN (SELECT country, language, avg(truth) AS truth_score FROM comparison GROUP BY ALL) tr
  USING (country, language)""" for t, c in RU.TESTS))


@register("percentage_series", _PSERIES_SQL)
def percentage_series(spark, sf_dir):
    """(country, language) score series of the three scenarios and the truth."""
    return RU.percentage_series(staged_comparison(spark, sf_dir))


_XLABEL = (f"CASE WHEN scenario = {S.q(R.SCENARIO_LANGUAGE)} THEN language "
           f"WHEN scenario = {S.q(R.SCENARIO_COUNTRY)} THEN country ELSE concat_ws(' | ', language, country) END")

_MLM_SQL = comp_sql(" UNION ALL ".join(f"""
SELECT '{t}' AS test, p.scenario, m.label AS model, m.ord, p.x_label, {S.stable('p.mae', 4)} AS mae
FROM (SELECT scenario, model, {_XLABEL} AS x_label, avg({c}_mae) AS mae FROM comparison GROUP BY ALL) p
JOIN {MODEL_DIM_SQL} m USING (model)""" for t, c in RU.TESTS))


@register("model_label_mae", _MLM_SQL)
def model_label_mae(spark, sf_dir):
    """Mean MAE per model and axis label of each scenario."""
    return RU.model_label_mae(staged_comparison(spark, sf_dir), R.model_dim(spark))


_LC_COLS = [R.NO_COUNTRY] + COUNTRIES
_LCM_SQL = comp_sql(f"""
SELECT test, language,
       {', '.join(f"{s2(f'avg(CASE WHEN country = {S.q(c)} THEN value END)')} * 100 AS {RU.slug(c)}"
                  for c in _LC_COLS)}
FROM lc_mae GROUP BY test, language""", _LC_MAE_CTE)


@register("language_country_matrix", _LCM_SQL)
def language_country_matrix(spark, sf_dir):
    """Language x country MAE matrix, x100, English row and No Country column first."""
    return RU.language_country_matrix(RU.language_country_mae(staged_comparison(spark, sf_dir)), COUNTRIES)
