"""Work units: enumeration, scenario-keyed lookup, completeness gate, status, pending work.

A *unit* is one (scenario, model, unit_key) answer set. The unit key depends on the
scenario: the language code, the country id, or ``<language_code>_<country_id>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas import rules as R

UNIT = ["scenario", "model", "unit_key"]


def unit_key_expr(scenario="scenario", language_code="language_code", country_id="country_id"):
    """The scenario-dependent key of a unit, as a column expression."""
    s, lc, cid = (F.col(x) if isinstance(x, str) else x for x in (scenario, language_code, country_id))
    return (F.when(s == R.SCENARIO_LANGUAGE, lc)
            .when(s == R.SCENARIO_COUNTRY, cid)
            .otherwise(F.concat_ws("_", lc, cid)))


def scenario_label_expr(scenario="scenario", language="language", country="country", country_id="country_id"):
    """Label of a unit in result tables: language / country / ``language - country_id``."""
    s = F.col(scenario)
    return (F.when(s == R.SCENARIO_LANGUAGE, F.col(language))
            .when(s == R.SCENARIO_COUNTRY, F.col(country))
            .otherwise(F.concat_ws(" - ", F.col(language), F.col(country_id))))


def country_language_pairs(countries: DataFrame) -> DataFrame:
    """One row per (country, language of that country): paired list columns to rows.

    ``countries`` has (country_id, country, languages ARRAY, language_codes ARRAY, ord).
    """
    return (countries
            .select("country_id", "country", "ord",
                    F.posexplode(F.arrays_zip("languages", "language_codes")).alias("lang_pos", "lc"))
            .select("country_id", "country", F.col("ord").alias("country_ord"), "lang_pos",
                    F.col("lc.languages").alias("language"), F.col("lc.language_codes").alias("language_code")))


def enumerate_units(countries: DataFrame, models: list[str], scenarios: list[str] | None = None) -> DataFrame:
    """All expected units: scenario x model x (country, language).

    Models and scenarios are bounded parameter lists, so they are attached with
    ``explode`` of a literal array -- no join, no shuffle.
    """
    scenarios = scenarios or R.SCENARIOS
    pairs = country_language_pairs(countries)
    return (pairs
            .withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
            .withColumn("unit_key", unit_key_expr())
            .select("scenario", "model", "unit_key", "country_id", "country", "language", "language_code",
                    "country_ord", "lang_pos"))


def completeness_gate(item_scores: DataFrame, n_criteria: int, keys: list[str] = UNIT) -> DataFrame:
    """Keep a unit only if it has exactly ``n_criteria`` rows with distinct criteria.

    The per-unit counts are a partial (map-side combined) aggregation, so a unit
    holding a large share of rows never lands in one task; the complete units
    are then semi-joined back, and the planner / AQE picks broadcast (small set)
    or a shuffle on the unit keys (which the downstream windows reuse).
    """
    complete = (item_scores.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("criterion_id").alias("_nd"))
                .where((F.col("_n") == n_criteria) & (F.col("_nd") == n_criteria))
                .select(*keys))
    # No hint: the (small) complete-unit set is known only at runtime, so AQE
    # picks broadcast or keeps the shuffle on the unit keys that the windows
    # downstream need anyway.
    return item_scores.join(complete, keys, "left_semi")


def unit_counts(item_scores: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    return item_scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.countDistinct("criterion_id").alias("n_criteria"))


def unit_status(expected_units: DataFrame, item_scores: DataFrame, n_criteria: int) -> DataFrame:
    """Diagnostics of the gate for every expected unit: complete / incomplete / missing."""
    expected = expected_units.select(*UNIT).distinct()
    counts = unit_counts(item_scores)
    return (expected.join(counts, UNIT, "left")
            .select(*UNIT,
                    F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.when(F.col("n_rows").isNull(), F.lit("missing"))
                    .when((F.col("n_rows") == n_criteria) & (F.col("n_criteria") == n_criteria), F.lit("complete"))
                    .otherwise(F.lit("incomplete")).alias("status")))


def pending_units(expected_units: DataFrame, item_scores: DataFrame, n_criteria: int) -> DataFrame:
    """Expected units that are not complete yet (anti join on the complete ones)."""
    done = completeness_gate(item_scores, n_criteria).select(*UNIT).distinct()
    return expected_units.select(*UNIT).distinct().join(done, UNIT, "left_anti")


def scenario_key_join(unit_rows: DataFrame, units: DataFrame) -> DataFrame:
    """Attach every (country, language) a unit is compared with.

    Equi join on (scenario, model, unit_key); keeps the fan-out: a language file
    meets every country speaking it, a country file every language of the country.
    """
    return unit_rows.join(units, UNIT, "inner")
