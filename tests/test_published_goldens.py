"""Golden checks against the published snapshot: per-file metric means (A5)
recomputed from the raw answer files equal the published metric tables."""

import pandas as pd
import pytest

from probitas import rules as R
from probitas.operators import rollups as RU
from probitas.operators.units import completeness_gate, enumerate_units
from probitas.sources import io as IO

from snapshot import answer_root, find, find_by_header

SKIP = "set PROBITAS_SNAPSHOT to a copy of the published results"
# Fixed test values: ISO codes of the snapshot's country files -> names as the published tables spell them.
ISO_NAMES = {
    "AM": "Armenia", "AT": "Austria", "AZ": "Azerbaijan", "BA": "Bosnia & Herzegovina", "BE": "Belgium",
    "BG": "Bulgaria", "BY": "Belarus", "CH": "Switzerland", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark",
    "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GE": "Georgia", "HR": "Croatia",
    "HU": "Hungary", "IE": "Ireland", "IS": "Iceland", "IT": "Italy", "LI": "Liechtenstein", "LT": "Lithuania",
    "LU": "Luxembourg", "LV": "Latvia", "MC": "Monaco", "MD": "Moldova", "ME": "Montenegro", "MK": "North Macedonia",
    "MT": "Malta", "NL": "Netherlands", "NO": "Norway", "PL": "Poland", "PT": "Portugal", "RO": "Romania",
    "RS": "Serbia", "RU": "Russia", "SE": "Sweden", "SI": "Slovenia", "SK": "Slovakia", "SM": "San Marino",
    "TR": "Turkey", "UA": "Ukraine", "XK": "Kosovo",
}


# Fixed test values: language codes of the snapshot's language files -> language names of the published tables.
LANGUAGE_NAMES = {"az": "Azerbaijani", "bs": "Bosnian", "da": "Danish", "en": "English", "lb": "Luxembourgish",
                  "pl": "Polish", "ru": "Russian", "tr": "Turkish", "cnr": "Montenegrin", "de": "German",
                  "ga": "Irish", "hu": "Hungarian", "is": "Icelandic", "lv": "Latvian", "nl": "Dutch", "mt": "Maltese"}


def _countries(spark, scenario):
    if scenario == R.SCENARIO_COUNTRY:
        rows = [(cid, name, ["x"], ["x"], i) for i, (cid, name) in enumerate(ISO_NAMES.items())]
    else:  # one pseudo-country per language: the label of a language unit is the language name
        rows = [(f"C{i}", f"C{i}", [name], [code], i) for i, (code, name) in enumerate(LANGUAGE_NAMES.items())]
    return spark.createDataFrame(rows, "country_id string, country string, languages array<string>, "
                                       "language_codes array<string>, ord int")


@pytest.mark.skipif(not answer_root(), reason=SKIP)
@pytest.mark.parametrize("scenario", [R.SCENARIO_COUNTRY, R.SCENARIO_LANGUAGE])
def test_unit_metric_means_equal_published(spark, scenario):
    items = IO.scan_answer_files(spark, answer_root(scenario))
    units = enumerate_units(_countries(spark, scenario), R.MODEL_LIST, [scenario])
    means = RU.unit_metric_means(completeness_gate(items, R.PUBLISHED_N_CRITERIA), units, R.model_dim(spark))
    got = {(r.metric, r.model, r.label): r.value for r in means.collect()}
    assert len(got) > 0
    checked = 0
    for metric, _ in RU.METRICS:
        pub = pd.read_csv(find(f"{scenario}/{metric}.csv"), index_col=0)
        for (m, model, label), v in got.items():
            if m != metric:
                continue
            want = pub.loc[model, label]
            assert (pd.isna(want) and v is None) or abs(float(want) - v) < 1e-9, (metric, model, label, v, want)
            checked += 1
    assert checked == len(got)


def _read_semicolon(spark, path):
    return spark.read.option("sep", ";").option("header", True).csv(path)


@pytest.mark.skipif(not find("country_model_Fact.csv"), reason=SKIP)
@pytest.mark.parametrize("test", ["Fact", "Stance"])
def test_distances_equal_published(spark, test):
    """P15 and A14 on the published integer tables: model - truth per country, and
    the per-model mean without the alphabetically last country."""
    from pyspark.sql import functions as F
    raw = _read_semicolon(spark, find(f"country_model_{test}.csv"))
    country, truth = raw.columns[0], raw.columns[1]  # first column: country; second: the truth score
    raw = raw.withColumnRenamed(country, "country").withColumnRenamed(truth, "truth")
    models = raw.columns[2:]
    long = (raw.unpivot(["country", "truth"], [f"`{m}`" for m in models], "model", "value")
            .select(F.lit(test).alias("test"), "country", "model",
                    F.col("truth").try_cast("long").alias("truth"), F.col("value").try_cast("long").alias("value")))
    dist = RU.distances(long)
    pub = pd.read_csv(find(f"model_country_distance_{test}.csv"), sep=";", index_col=0)
    got = {(r.model, r.country): r.distance for r in dist.collect()}
    for (model, country), v in got.items():
        want = pub.loc[model, country]
        assert (pd.isna(want) and v is None) or float(want) == v, (model, country)
    means = {r.model: r.avg_distance for r in RU.mean_distance(dist, drop_last_country=True).collect()}
    for model, v in means.items():
        assert abs(round(float(pub.loc[model, "avg_distance"]), 4) - v) < 1e-9, model


BT_TABLE = find_by_header("model;", ";avg_score")


@pytest.mark.skipif(not BT_TABLE, reason=SKIP)
def test_backtranslation_average_equals_published(spark):
    """A16 on the published back-translation table: mean over languages without Montenegrin."""
    from pyspark.sql import functions as F

    from probitas.operators.translation import avg_excluding_category
    raw = _read_semicolon(spark, BT_TABLE)
    langs = [c for c in raw.columns if c not in ("model", "avg_score")]
    long = raw.unpivot(["model"], langs, "language", "score").select(
        "model", "language", F.col("score").try_cast("double").alias("score"))
    got = {r.model: r.avg_score for r in avg_excluding_category(long).collect()}
    pub = pd.read_csv(BT_TABLE, sep=";", index_col="model")
    assert len(got) == len(pub) == 11
    for model, v in got.items():
        assert abs(float(pub.loc[model, "avg_score"]) - v) < 1e-9, model


@pytest.mark.skipif(not find(f"{R.SCENARIO_COUNTRY}/fact_coh.csv"), reason=SKIP)
@pytest.mark.parametrize("scenario", [R.SCENARIO_COUNTRY, R.SCENARIO_LANGUAGE])
def test_metric_matrix_average_equals_published(spark, scenario):
    """R2 / A15 on the published matrices: long -> matrix with the row average of the cells."""
    from pyspark.sql import functions as F
    for metric, _ in RU.METRICS:
        path = find(f"{scenario}/{metric}.csv")
        pub = pd.read_csv(path, index_col=0)
        avg_col = [c for c in pub.columns if c.endswith("Average")][0]
        labels = [c for c in pub.columns if c != avg_col]
        raw = spark.read.option("header", True).csv(path).withColumnRenamed("_c0", "model")
        long = (raw.unpivot(["model"], [f"`{l}`" for l in labels], "label", "value")
                .select(F.lit(scenario).alias("scenario"), F.lit(metric).alias("metric"), "model", "label",
                        F.col("value").try_cast("double").alias("value")))
        got = {r.model: r for r in RU.metric_matrix(long, scenario, labels).collect()}
        assert set(got) == set(pub.index)
        for model, row in got.items():
            want = pub.loc[model, avg_col]
            assert (pd.isna(want) and row.average is None) or abs(float(want) - row.average) < 1e-9, (metric, model)
            for label in labels:
                cell, ref = row[RU.slug(label)], pub.loc[model, label]
                assert (pd.isna(ref) and cell is None) or abs(float(ref) - cell) < 1e-9, (metric, model, label)
