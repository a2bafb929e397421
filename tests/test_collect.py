"""The collection runner, its stores, and the question and prompt documents."""

import json
import os
import tempfile

import pytest
from conftest import SF_SMALL
from probitas.operators.samples import REPLY_KEY, drop_empty_responses
from probitas.operators.units import UNIT
from probitas.plans.collect import collect
from probitas.plans.inputs import Inputs
from probitas.sources import io as IO
from probitas.sources import store as ST


def _base(spark):
    return spark.createDataFrame([(c, t, f"Does item {c} hold {t}?") for c in range(3) for t in ("Fact", "Support", "Opposition")],
                                 "criterion_id int, question_type string, text string")


def test_second_run_asks_only_for_what_is_left(spark):
    inp = Inputs.of(spark, SF_SMALL)
    units = inp.units.where("model in ('deepseek-chat', 'gpt-5.4') and scenario <> 'language_country_scenario'")
    out = tempfile.mkdtemp(prefix="probitas-collect-", dir="/tmp")
    prompts = inp.prompts

    def shy(batches):  # says nothing about one country
        for pdf in batches:
            yield pdf.assign(response=["" if k == "IT" else "yes." for k in pdf["unit_key"]])

    def open_minded(batches):
        for pdf in batches:
            assert set(pdf["unit_key"]) == {"IT"}
            yield pdf.assign(response="no")

    first = {tuple(r[:3]): r.status for r in collect(spark, units, _base(spark), prompts, shy, out, 3, max_attempts=6).collect()}
    expected = {tuple(r) for r in units.select("scenario", "model", "unit_key").distinct().collect()}
    asked = {(r.scenario, r.model, r.unit_key): r.status for r in spark.createDataFrame(
        [(*k, v) for k, v in first.items()], [*UNIT, "status"]).collect()}
    assert set(asked) == expected
    left = {k for k, v in asked.items() if v == "short"}
    assert left and all(k[2] == "IT" for k in left)
    second = collect(spark, units, _base(spark), prompts, open_minded, out, 3).collect()
    assert {(r.scenario, r.model, r.unit_key) for r in second} == left and {r.status for r in second} == {"complete"}
    assert collect(spark, units, _base(spark), prompts, open_minded, out, 3).count() == 0
    store = IO.scan_answer_store(spark, f"{out}/answers")
    assert store.count() == 3 * len(expected) == store.select(*UNIT, "criterion_id").distinct().count()
    replies = ST.read_store(spark, f"{out}/replies")
    assert drop_empty_responses(replies).count() == len(expected) * 3 * 3 * 5
    assert replies.select(*REPLY_KEY).distinct().count() == replies.count()


def _noting(path, reply, lost=None):
    """A responder that notes what it is asked, and fails when it is asked for the attempt ``lost``."""
    def respond(batches):
        import os
        for pdf in batches:
            if lost is not None and (pdf["sample_order"] >= lost).any():
                raise RuntimeError("connection lost")
            keys = ["\t".join(map(str, k)) for k in pdf[["model", "unit_key", "criterion_id", "question_type", "sample_order"]].itertuples(index=False)]
            with open(f"{path}/{os.getpid()}", "a", encoding="utf-8") as f:
                f.writelines(k + "\n" for k in keys)
            yield pdf.assign(response=[reply(k) for k in pdf["sample_order"]])
    return respond


def _asked(path):
    return [line for name in os.listdir(path) for line in open(f"{path}/{name}", encoding="utf-8")]


def test_a_stopped_run_goes_on_where_it_was(spark, monkeypatch):
    inp = Inputs.of(spark, SF_SMALL)
    units = inp.units.where("model = 'gpt-5.4' and scenario = 'country_scenario'")
    out, calls = (tempfile.mkdtemp(prefix="probitas-resume-", dir="/tmp") for _ in range(2))
    every_third = lambda k: "" if k % 3 == 0 else "yes"
    base = _base(spark)
    with pytest.raises(Exception, match="connection lost"):  # the second round asks for attempts from 6 on
        collect(spark, units, base, inp.prompts, _noting(calls, every_third, lost=6), out, 3)
    first = _asked(calls)
    assert len(first) == len(set(first)) > 0 and not ST.store_exists(spark, f"{out}/answers")
    with monkeypatch.context() as m:  # all is asked, then the run stops before the answers are stored
        m.setattr(ST, "upsert", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            collect(spark, units, base, inp.prompts, _noting(calls, every_third), out, 3)
    second = _asked(calls)
    assert len(second) == len(set(second)) > len(first)
    report = {}
    done = collect(spark, units, base, inp.prompts, _noting(calls, every_third), out, 3, report=report).collect()
    assert {r.status for r in done} == {"complete"} and sorted(_asked(calls)) == sorted(second)  # nothing left to ask
    replies = ST.read_store(spark, f"{out}/replies")
    assert replies.count() == replies.select(*REPLY_KEY).distinct().count() == len(second)
    n = units.select("unit_key").distinct().count()
    assert ST.read_store(spark, f"{out}/answers").count() == 3 * n
    assert report == {"questions": 9 * n, "questions_dropped": 0}


def test_missing_questions_are_reported(spark):
    inp = Inputs.of(spark, SF_SMALL)
    units = inp.units.where("model = 'gpt-5.4' and unit_key = 'IT'")
    out = tempfile.mkdtemp(prefix="probitas-missing-", dir="/tmp")
    base = _base(spark).where("not (criterion_id = 1 and question_type = 'Support')")
    report = {}
    done = collect(spark, units, base, inp.prompts, _noting(tempfile.mkdtemp(dir="/tmp"), lambda k: "yes"), out, 3, report=report).collect()
    assert report == {"questions": 9, "questions_dropped": 1} and [r.status for r in done] == ["short"]


def test_question_files_in_their_nested_layout(spark):
    root = tempfile.mkdtemp(prefix="probitas-questions-", dir="/tmp")
    for scenario, key in (("country_scenario", "IT"), ("language_country_scenario", "de_IT")):
        os.makedirs(f"{root}/{scenario}")
        with open(f"{root}/{scenario}/questions_{key}.csv", "w", encoding="utf-8") as f:
            f.write(f"criterion_id;Fact;Support;Opposition\n0;In {key}, a?;b;c\n1;d;;e\n")
    rows = sorted(tuple(r) for r in IO.scan_questionnaire_files(spark, root, "questions_").collect())
    assert rows[0] == ("country_scenario", "IT", 0, "In IT, a?", "b", "c") and rows[3] == ("language_country_scenario", "de_IT", 1, "d", None, "e")


def test_prompt_document(spark):
    root = tempfile.mkdtemp(prefix="probitas-prompts-", dir="/tmp")
    doc = {"English": {"prompt": "Answer", "yes": "yes", "no": "no"}, "French": {"prompt": "R\u00e9ponds \u00ab oui \u00bb", "yes": "oui", "no": "non"}}
    with open(f"{root}/prompt.json", "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=4, ensure_ascii=False)
    rows = {r.language: (r.prompt, r.yes, r.no) for r in IO.scan_prompts(spark, f"{root}/prompt.json").collect()}
    assert rows == {k: tuple(v.values()) for k, v in doc.items()}
