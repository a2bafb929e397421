"""Roll-up rules on a hand-made comparison table (independent of the oracle)."""

from probitas import rules as R
from probitas.operators import rollups as RU

COLS = ("scenario string, model string, unit_key string, country_id string, country string, language string, "
        "language_code string, fact double, stance double, truth double, fact_stat double, fact_pvalue double, "
        "fact_mae double, stance_stat double, stance_pvalue double, stance_mae double")


def _row(scen, model, country, lang, fact, fact_p, fact_mae):
    return (scen, model, "k", country[:2].upper(), country, lang, "xx", fact, fact, 50.0, 1.0, fact_p, fact_mae,
            1.0, 0.5, 0.4)


def test_mae_summary_rules(spark):
    m = "gpt-5.4"
    rows = [_row(R.SCENARIO_LANGUAGE, m, "Italy", "Italian", 40.0, 0.01, 0.335),
            _row(R.SCENARIO_LANGUAGE, m, "Malta", "Maltese", 42.0, 0.20, 0.335),
            _row(R.SCENARIO_COUNTRY, m, "Italy", "Italian", 44.0, 0.04, 0.5),
            _row(R.SCENARIO_COUNTRY, m, "Malta", "Maltese", 46.0, 0.049, 0.6)]
    comp = spark.createDataFrame(rows, COLS)
    fact = [r for r in RU.model_mae_summary(comp, R.model_dim(spark)).collect() if r.test == "Fact"][0]
    lang, ctry = _r2((0.335 + 0.335) / 2), _r2((0.5 + 0.6) / 2)
    assert fact.language_scenario == f"{lang} 50.0\\%"      # 1 of 2 rows with p < 0.05
    assert fact.country_scenario == f"{ctry} 100.0\\%"
    assert fact.language_country_scenario == "-"              # no rows in that scenario
    # average of the *rounded* scenario MAEs and the pooled share 3 / 4
    assert fact.average == f"{_r2((lang + ctry) / 2)} 75.0\\%"


def _r2(v):
    """The stable 2-decimal rule: snap to 10 decimals, then half-even on the binary value."""
    import numpy as np
    return float(np.rint(np.rint(v * 1e10) / 1e10 * 100) / 100)


def test_percentage_average_of_rounded(spark):
    m = "gpt-5.4"
    rows = [_row(R.SCENARIO_LANGUAGE, m, "Italy", "Italian", 40.5, 0.5, 0.1),
            _row(R.SCENARIO_COUNTRY, m, "Italy", "Italian", 41.5, 0.5, 0.1),
            _row(R.SCENARIO_LANGUAGE_COUNTRY, m, "Italy", "Italian", 43.0, 0.5, 0.1)]
    r = RU.model_scenario_percentage(spark.createDataFrame(rows, COLS), R.model_dim(spark)).first()
    assert (r.language_scenario_fact, r.country_scenario_fact, r.language_country_scenario_fact) == (40, 42, 43)
    assert r.fact_average == 42  # mean of the rounded integers (40 + 42 + 43) / 3 = 41.67 -> 42
