"""Collection run: ask what is still missing, keep every reply, score, and append to the answer store.

pending units -> questionnaire -> prompts -> responder -> ledger of replies -> answer rows -> answer store. A unit is
stored once it is complete. A second run asks only for the units that are left, and of those only the replies that
the ledger lacks.

usage: python -m probitas.plans.collect --sf-dir /root/testdata/sf0.001 --out <dir> [--responder module:function]
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from probitas import rules as R
from probitas.operators import asking
from probitas.operators import questionnaire as Q
from probitas.operators import samples as SM
from probitas.operators import units as U
from probitas.session import get_session, materialize
from probitas.sources import io as IO
from probitas.sources import store as ST


def collect(spark: SparkSession, units: DataFrame, base_questions: DataFrame, prompts: DataFrame, responder, out: str,
            n_criteria: int, n: int = R.SAMPLES_PER_QUESTION, max_attempts: int = 10 * R.SAMPLES_PER_QUESTION,
            report: dict | None = None, calls_at_once: int | None = None) -> DataFrame:
    """One run over all pending units; returns (scenario, model, unit_key, status) of what it asked for.

    ``out`` holds the stores ``replies`` (by unit, criterion, question type and attempt) and ``answers`` (by unit and
    criterion). Status is complete (the unit's answers are stored) or short (some criterion still lacks a reply;
    asked for again by the next run). With ``calls_at_once``, ``responder`` is a function of one question, which
    that many threads of an executor call at a time in one job (:mod:`probitas.operators.asking`). A run that was stopped can be started again at any point: replies of finished
    rounds are neither asked for nor stored again, and answers are upserted by their key. ``questions_dropped`` in
    ``report``, if one is given, is the number of missing questions that were not asked.
    """
    store = f"{out}/answers"
    if ST.store_exists(spark, store):
        pending = U.pending_units(units, IO.scan_answer_store(spark, store, units=units), n_criteria)
    else:
        pending = units.select(*U.UNIT).distinct()
    pending = materialize(pending, "pending")
    open_units = units.join(pending, U.UNIT, "left_semi")
    questionnaire = Q.build_questionnaire(open_units, base_questions)
    dropped = Observation("questions")
    asked = Q.build_prompts(questionnaire, open_units, prompts, dropped if report is not None else None)
    # a question goes to every model that lacks the unit
    questions = materialize(asked.join(pending, ["scenario", "unit_key"]), "questions")
    ledger = f"{out}/replies"
    if calls_at_once is None:
        got = SM.collect_samples(questions, responder, n, max_attempts, ledger)
    else:
        got = asking.collect_by_calls(questions, responder, n, max_attempts, calls_at_once, ledger=ledger, report=report)
    got = materialize(got, "collected")
    if report is not None:
        report.update(dropped.get)
    replies = SM.drop_empty_responses(got)
    rows = SM.answer_rows(SM.sample_scores(SM.label_samples(replies, prompts), n))
    full = U.completeness_gate(rows.where(F.col("fact").isNotNull() & F.col("stance").isNotNull()), n_criteria)
    done = materialize(full.select("scenario", "model", "unit_key", *IO.ANSWER_COLUMNS), "answers")
    ST.upsert(done, store, [*U.UNIT, "criterion_id"], ["scenario", "model"])
    complete = done.select(*U.UNIT).distinct().withColumn("status", F.lit("complete"))
    return pending.join(complete, U.UNIT, "left").withColumn("status", F.coalesce("status", F.lit("short")))


def main() -> None:
    from probitas.plans.inputs import Inputs
    from probitas.sources import driver_tables as D
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--responder", default="probitas.plans.text_queries:formula_responder")
    ap.add_argument("--calls-at-once", type=int, default=None, help="the responder answers one question; so many calls of an executor at a time")
    ap.add_argument("--master", default=None)
    a = ap.parse_args()
    spark = get_session(a.master)
    module, name = a.responder.split(":")
    inp = Inputs.of(spark, a.sf_dir)
    base = D.base_questions(spark, a.sf_dir)
    n_criteria = base.select("criterion_id").distinct().count()
    report: dict = {}
    out = collect(spark, inp.units, base, inp.prompts, getattr(importlib.import_module(module), name), a.out, n_criteria, report=report,
                  calls_at_once=a.calls_at_once)
    out.groupBy("status").count().show()
    print(report)


if __name__ == "__main__":
    main()
