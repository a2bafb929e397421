"""End-to-end evaluation run: every result table of the method, written once.

Inputs are either the driver's test tables (``--sf-dir``) or the method's own
files: the answer files in their original layout, the wide truth table, the
criterion weights and the countries document (``--answers --truth --weights
--countries``). Missing inputs stop the run with a clear message instead of
silently skipping tables (S8). The comparison table is the one stage boundary
(S9): written to Parquet, then every roll-up reads it.

usage: python -m probitas.plans.evaluate --sf-dir /root/testdata/sf0.01 --out /path/out
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas import rules as R
from probitas.operators import rollups as RU
from probitas.operators.compare import comparison_table, countries_without_truth
from probitas.operators.units import completeness_gate, enumerate_units
from probitas.plans.inputs import Inputs
from probitas.session import get_session, materialize, path_exists
from probitas.sources import io as IO


class MissingInput(RuntimeError):
    pass


def require(spark: SparkSession, paths: dict[str, str | None]) -> None:
    """Fail clearly when an input is absent (instead of skipping its tables), on any file system."""
    missing = [f"{k}: {v}" for k, v in paths.items() if not v or not path_exists(spark, v)]
    if missing:
        raise MissingInput("missing inputs -> " + "; ".join(missing))


def read_truth_wide(spark: SparkSession, path: str) -> DataFrame:
    """Wide truth CSV (country_id; country_name; Rank; one column per criterion in
    criterion order) to long (country_id, criterion_id, score): criterion ids are
    column positions."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    crit = [c for c in raw.columns if c not in ("country_id", "country_name", "Rank")]
    long = raw.unpivot(["country_id"], crit, "criterion", "score")
    pos = F.create_map(*[x for i, c in enumerate(crit) for x in (F.lit(c), F.lit(i))])
    return long.select("country_id", F.element_at(pos, F.col("criterion")).cast("int").alias("criterion_id"),
                       F.col("score").try_cast("double").alias("score"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    return raw.select(F.col("criterion_id").cast("int"), F.col("Weight").try_cast("double").alias("weight"))


COUNTRY_RECORD = T.StructType([T.StructField("country_id", T.StringType()),
                               T.StructField("citizenships", T.StringType()),
                               T.StructField("languages", T.ArrayType(T.StringType())),
                               T.StructField("languages_code", T.ArrayType(T.StringType()))])


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Countries document {name: {country_id, citizenships, languages, languages_code}}
    to the countries dimension; document order becomes ``ord``."""
    doc = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), COUNTRY_RECORD))
    return (doc.select(F.posexplode(m).alias("ord", "country", "v"))
            .select(F.col("v.country_id").alias("country_id"), "country",
                    F.col("v.citizenships").alias("citizenship"), F.col("v.languages").alias("languages"),
                    F.col("v.languages_code").alias("language_codes"), F.col("ord").cast("int")))


def published(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A result table as it is published: systems, countries and unit labels spelt out in the header, rows in the
    systems' reporting order where the table has one."""
    out = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    return out.orderBy("ord") if "ord" in df.columns else out


def result_tables(comp: DataFrame, gated_items: DataFrame, units: DataFrame, spark: SparkSession, names: dict[str, str]) -> dict:
    """All result tables; ``names`` is filled with the label behind every column name that was made from one."""
    models = R.model_dim(spark)
    labels = [R.MODEL_LABEL.get(m, m) for m in R.MODEL_LIST]
    # pivot values: the bounded list of country names
    countries = sorted(r[0] for r in comp.select("country").distinct().collect())
    sc_mae = RU.scenario_country_mae(comp)
    lc_mae = RU.language_country_mae(comp)
    means = materialize(RU.unit_metric_means(gated_items, units, models), "unit-metric-means")  # scans the answers once
    matrices = {}
    names.update({RU.slug(x): x for x in [*labels, *countries, R.NO_COUNTRY]})
    for s in R.SCENARIOS:
        # pivot values: the bounded label list of the scenario
        unit_labels = sorted(r[0] for r in means.where(F.col("scenario") == s).select("label").distinct().collect())
        matrices[f"metric_matrix_{s}"] = RU.metric_matrix(means, s, unit_labels)
        names.update({RU.slug(x): x for x in unit_labels})
    return {
        "unit_metric_means": means,
        **matrices,
        "model_mae_summary": RU.model_mae_summary(comp, models),
        "language_country_mae": lc_mae,
        "scenario_country_mae": sc_mae,
        "model_scenario_percentage": RU.model_scenario_percentage(comp, models),
        "country_model_percentage": RU.country_model_percentage(comp, models, labels),
        "model_country_distance": RU.distance_matrix(comp, models, countries),
        "avg_distance": RU.avg_distance(comp, models),
        "avg_distance_compat": RU.avg_distance(comp, models, drop_last_country=True),
        "truth_vs_mae": RU.truth_vs_mae(comp),
        "scenario_country_series": RU.scenario_country_series(sc_mae),
        "percentage_series": RU.percentage_series(comp),
        "model_label_mae": RU.model_label_mae(comp, models),
        "language_country_matrix": RU.language_country_matrix(lc_mae, countries),
    }


def run(spark: SparkSession, out: str, sf_dir: str | None = None, answers: str | None = None,
        truth: str | None = None, weights: str | None = None, countries: str | None = None,
        rules: R.AuditRules | None = None, csv: bool = True) -> dict:
    if sf_dir:
        require(spark, {"sf_dir": sf_dir})
        inp = Inputs.of(spark, sf_dir)
        items, truth_long, w, ctry, rules = inp.item_scores, inp.truth_long, inp.weights, inp.countries, inp.rules
    else:
        require(spark, {"answers": answers, "truth": truth, "weights": weights, "countries": countries})
        rules = rules or R.AuditRules()
        items = IO.scan_answer_files(spark, answers)
        truth_long, w = read_truth_wide(spark, truth), read_weights(spark, weights)
        ctry = read_countries(spark, countries)
    units = enumerate_units(ctry, R.MODEL_LIST)
    lost = sorted(r[0] for r in countries_without_truth(units, truth_long, rules).collect())  # as few as there are countries
    if lost:
        raise MissingInput(f"{len(lost)} countries without a complete truth vector: {', '.join(lost)}")
    comp = materialize(comparison_table(items, truth_long, w, units, rules), "comparison")
    names: dict[str, str] = {}
    tables = {"comparison": comp, **result_tables(comp, completeness_gate(items, rules.n_criteria), units, spark, names)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        if csv:  # from the written table, in parallel part files
            IO.write_delimited(published(spark.read.parquet(f"{out}/{name}"), names), f"{out}/csv/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--out", required=True)
    ap.add_argument("--sf-dir")
    ap.add_argument("--answers")
    ap.add_argument("--truth")
    ap.add_argument("--weights")
    ap.add_argument("--countries")
    ap.add_argument("--master", default=None)
    a = ap.parse_args()
    spark = get_session(a.master)
    run(spark, a.out, a.sf_dir, a.answers, a.truth, a.weights, a.countries)


if __name__ == "__main__":
    main()
