"""The evaluation runner: driver tables and the original file formats give the same tables."""

import json
import os
import tempfile

import pytest

from conftest import SF_SMALL
from probitas import rules as R
from probitas.plans import evaluate as EV
from probitas.plans.inputs import Inputs
from probitas.sources import io as IO


def _write_original_formats(spark, root):
    inp = Inputs.of(spark, SF_SMALL)
    items = inp.item_scores.toPandas()
    for (s, m, k), g in items.groupby(["scenario", "model", "unit_key"]):
        d = os.path.join(root, "answers", s, m)
        os.makedirs(d, exist_ok=True)
        g = g.sort_values("criterion_id")[IO.ANSWER_COLUMNS]
        g.columns = IO.ANSWER_FILE_COLUMNS
        g.to_csv(os.path.join(d, f"rm_answers_{k}.csv"), sep=";", index=False)
    wide = inp.truth_wide.toPandas().rename(columns={"country": "country_name"})
    wide.insert(2, "Rank", 0)
    wide.to_csv(os.path.join(root, "truth.csv"), sep=";", index=False)
    inp.weights.toPandas().rename(columns={"weight": "Weight"}).to_csv(os.path.join(root, "weights.csv"), sep=";",
                                                                       index=False)
    doc = {r.country: {"country_id": r.country_id, "citizenships": r.citizenship, "languages": list(r.languages),
                       "languages_code": list(r.language_codes)}
           for r in inp.countries.orderBy("ord").collect()}
    with open(os.path.join(root, "countries.json"), "w") as f:
        json.dump(doc, f)


def test_file_formats_match_driver_tables(spark):
    root = tempfile.mkdtemp(prefix="probitas-eval-", dir="/tmp")
    _write_original_formats(spark, root)
    a = EV.run(spark, f"{root}/out_a", sf_dir=SF_SMALL, csv=False)
    b = EV.run(spark, f"{root}/out_b", answers=f"{root}/answers", truth=f"{root}/truth.csv",
               weights=f"{root}/weights.csv", countries=f"{root}/countries.json", rules=R.TEST_RULES, csv=True)
    for name in ("comparison", "model_mae_summary", "country_model_percentage", "unit_metric_means"):
        ra = sorted(map(tuple, a[name].collect()), key=repr)
        rb = sorted(map(tuple, b[name].collect()), key=repr)
        assert ra == rb and len(ra) > 0, name
    assert os.path.isdir(f"{root}/out_b/csv/comparison")
    printed = spark.read.option("sep", ";").option("header", True).csv(f"{root}/out_b/csv/country_model_percentage").columns
    assert printed[3:] == [R.MODEL_LABEL[m] for m in R.MODEL_LIST]  # as published, not as column names
    from probitas.operators.rollups import slug
    cols = a["country_model_percentage"].columns
    assert cols[:3] == ["test", "country", "truth"] and cols[3:] == [slug(R.MODEL_LABEL[m]) for m in R.MODEL_LIST]
    assert set(a["metric_matrix_country_scenario"].columns) >= {"metric", "model", "average"}


def test_missing_input_fails_clearly(spark):
    with pytest.raises(EV.MissingInput):
        EV.run(spark, "/tmp/unused", answers="/nonexistent", truth=None, weights=None, countries=None)
