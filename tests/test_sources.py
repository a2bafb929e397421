"""Sources and sinks: the original answer-file layout (published snapshot), JSON map documents."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas.operators import units as U
from probitas.sources import io as IO

from snapshot import answer_root

ANSWERS = answer_root()


@pytest.mark.skipif(not ANSWERS, reason="set PROBITAS_SNAPSHOT to a copy of the published answer files")
def test_scan_published_answer_files(spark):
    df = IO.scan_answer_files(spark, ANSWERS)
    assert df.count() == 18120
    files = df.select("scenario", "model", "unit_key").distinct()
    assert files.count() == 241
    assert df.where(F.col("model").contains("/")).count() > 0  # nested model names parsed
    counts = {(r.model, r.unit_key): r.n_rows for r in U.unit_counts(df).collect()}
    assert counts[("gpt-5.4-mini", "sr_XK")] == 3
    assert counts[("gpt-5.4-mini", "de_LI")] == 14
    assert counts[("gpt-5.4-mini", "tr_TR")] == 15
    assert U.completeness_gate(df, 76).select(*U.UNIT).distinct().count() == 238
    # stored stance equals (support + |opposition - 1|) / 2 within rounding
    bad = df.where(F.abs(F.col("stance") - (F.col("support") + F.abs(F.col("opposition") - 1)) / 2) > 0.0051)
    assert bad.count() == 0


def test_json_map_roundtrip(spark, tmp_path):
    doc = {"Italy": {"country_id": "IT", "languages": ["Italian", "German"]}, "Malta": {"country_id": "MT",
                                                                                       "languages": ["Maltese"]}}
    p = tmp_path / "countries.json"
    p.write_text(json.dumps(doc))
    schema = T.StructType([T.StructField("country_id", T.StringType()),
                           T.StructField("languages", T.ArrayType(T.StringType()))])
    rows = {r.key: (r.country_id, r.languages) for r in IO.scan_json_map(spark, str(p), schema).collect()}
    assert rows == {"Italy": ("IT", ["Italian", "German"]), "Malta": ("MT", ["Maltese"])}
    arr = tmp_path / "q.json"
    arr.write_text(json.dumps(["a", "b"]))
    assert [(r.pos, r.value) for r in IO.scan_json_array(spark, str(arr)).collect()] == [(0, "a"), (1, "b")]


def test_answer_store_lookup_prunes_and_pushes_down(spark, tmp_path):
    import contextlib
    import io

    from conftest import SF_SMALL
    from probitas.plans.inputs import Inputs
    root = str(tmp_path / "store")
    items = Inputs.of(spark, SF_SMALL).item_scores
    IO.write_answer_store(items, root)
    one = IO.scan_answer_store(spark, root, scenario="country_scenario", model="deepseek-chat", unit_key="IT")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one.select("criterion_id", "fact").explain()
    plan = buf.getvalue()
    part = plan[plan.index("PartitionFilters: ["):]
    assert part.startswith("PartitionFilters: [isnotnull(scenario") and "= country_scenario)" in part
    assert "PushedFilters: [IsNotNull(unit_key), EqualTo(unit_key,IT)]" in plan
    assert "ReadSchema: struct<unit_key:string,criterion_id:int,fact:double>" in plan
    want = items.where("scenario = 'country_scenario' AND model = 'deepseek-chat' AND unit_key = 'IT'").count()
    assert one.count() == want > 0


def test_keyed_files_flat_and_nested(spark, tmp_path):
    """Questionnaire-style flat files and answer-style nested files, keys from the path."""
    from pyspark.sql import types as T
    for rel in ("language_scenario/qn_en.csv", "country_scenario/qn_IT.csv",
                "language_country_scenario/some/model/qn_de_IT.csv"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("criterion_id;Fact\n0;Is it?\n1;Is that?\n")
    schema = T.StructType([T.StructField("criterion_id", T.IntegerType()), T.StructField("Fact", T.StringType())])
    rows = {(r.scenario, r.subpath, r.unit_key) for r in IO.scan_keyed_files(spark, str(tmp_path), "qn_", schema)
            .collect()}
    assert rows == {("language_scenario", "", "en"), ("country_scenario", "", "IT"),
                    ("language_country_scenario", "some/model", "de_IT")}


def test_read_matrix_names_row_labels(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(",Italy,Malta,Fact Average\nQwen 2B,1.0,0.5,0.75\nGemini,,1.0,1.0\n")
    df = IO.read_matrix(spark, str(p))
    assert df.columns[0] == "model" and {r.model for r in df.collect()} == {"Qwen 2B", "Gemini"}


def test_broken_records_are_told_apart(spark):
    root = tempfile.mkdtemp(prefix="probitas-broken-", dir="/tmp")
    with open(f"{root}/a.csv", "w", encoding="utf-8") as f:
        f.write("id;score;note\n1;0.5;fine\n2;half;bad cell\n3;0.25\n4;1;x;too many\n5;;empty score\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("note", T.StringType())])
    rows, broken = IO.read_checked(spark, root, schema)
    assert sorted(map(tuple, rows.collect())) == [(1, 0.5, "fine"), (5, None, "empty score")]
    assert sorted(r.id for r in rows.select("id").collect()) == [1, 5] and rows.count() == 2  # whichever columns are read
    assert sorted(r.record for r in broken.collect()) == ["2;half;bad cell", "3;0.25", "4;1;x;too many"]
    IO.quarantine(broken, f"{root}/quarantine")
    kept = {r.record: json.loads(r.cells) for r in spark.read.json(f"{root}/quarantine").collect()}
    assert kept["2;half;bad cell"] == {"id": 2, "note": "bad cell"} and len(kept) == 3
