"""Concurrent calls inside tasks: the attempts made, retries, the limit on calls at a time, resumed runs."""

import os
import tempfile
import threading
import time

import pytest
from probitas.operators import asking
from probitas.operators import samples as SM
from probitas.sources import store as ST
from pyspark.sql import functions as F

QUESTION = "scenario string, model string, unit_key string, criterion_id int, question_type string, full_prompt string"


def _questions(spark, n, models=("m",)):
    return spark.createDataFrame([("s", m, f"u{i}", i, "Fact", f"q{i}" if i else None) for m in models for i in range(n)], QUESTION)


def _rules():
    """Every third attempt of odd questions is blank or null; question 4 never has a reply. (Made here, so that workers
    need not import this module.)"""
    def rule(criterion, attempt):
        if criterion == 4:
            return ""
        if criterion % 2 and attempt % 3 == 0:
            return None if attempt % 2 else "  "
        return f"yes {criterion} {attempt}"
    return rule


def _folder():
    return tempfile.mkdtemp(prefix="probitas-asking-", dir="/tmp")


def test_the_same_replies_as_by_rounds(spark):
    questions, rule = _questions(spark, 9, ("a", "b")), _rules()

    def by_rounds(batches):
        for pdf in batches:
            yield pdf.assign(response=[rule(c, k) for c, k in zip(pdf["criterion_id"], pdf["sample_order"])])

    def one(q):
        assert (q["full_prompt"] is None) == (q["criterion_id"] == 0)
        time.sleep(0.01 * (q["criterion_id"] % 3))  # replies come out of order
        return rule(q["criterion_id"], q["sample_order"])

    stores = [_folder() + "/replies" for _ in range(3)]
    cols = [*SM.GROUP, "full_prompt", "n_samples", "sample_order", "response", "sample_no", "status"]
    report = {}
    a = SM.collect_samples(questions, by_rounds, 5, 12, stores[0])
    b = asking.collect_by_calls(questions, one, 5, 12, ledger=stores[1], report=report)
    c = asking.collect_by_calls(questions, one, 5, 12, ledger=stores[2], jobs=3)
    plain = asking.collect_by_calls(questions, one, 5, 12)
    expected = sorted(map(tuple, a.select(cols).collect()), key=repr)
    assert len(expected) == 2 * (8 * 5 + 1)
    for got in (b, c, plain):
        assert sorted(map(tuple, got.select(cols).collect()), key=repr) == expected
    ledgers = [sorted(map(tuple, ST.read_store(spark, s).select(*SM.REPLY_KEY, "response").collect()), key=repr) for s in stores]
    assert ledgers[0] == ledgers[1] == ledgers[2]
    assert report == {"attempts": len(ledgers[0]), "calls": len(ledgers[0]), "failed": 0}


def test_failing_calls_are_repeated_and_reported(spark):
    notes = _folder()

    def shaky(q):
        name = f"{notes}/{q['criterion_id']}-{q['sample_order']}"
        tries = int(open(name).read()) if os.path.exists(name) else 0
        with open(name, "w") as f:
            f.write(str(tries + 1))
        if q["criterion_id"] == 2 or tries < 2:
            raise TimeoutError("no answer")
        return "yes"

    report = {}
    got = asking.collect_by_calls(_questions(spark, 3), shaky, 2, 3, retries=2, pause=0.01, report=report)
    status = {r.criterion_id: (r.status, r.n_samples) for r in got.collect()}
    assert status == {0: ("complete", 2), 1: ("complete", 2), 2: ("short", 0)}
    # two questions with two attempts of three tries; the third has three attempts of three tries, all lost
    assert report == {"attempts": 7, "calls": 21, "failed": 3}
    lost = asking.collect_by_calls(_questions(spark, 1), lambda q: 1 / 0, 1, 1, retries=0)
    assert [(r.response, r.status) for r in lost.collect()] == [(None, "short")]


def test_calls_at_a_time_and_one_job_for_late_replies():
    lock, now, most = threading.Lock(), [0], [0]

    def slow(q):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return "yes" if q["sample_order"] > 4 else ""

    import pandas as pd
    rows = pd.DataFrame({"criterion_id": range(20), "_have": 0, "_asked": 0, "_most": 9})
    start = time.time()
    out = pd.concat(list(asking.asker(slow, 2, 8, 0, 0.0, chunk=7)(iter([rows]))))
    assert most[0] == 8 and time.time() - start < 0.6 * 20 * 6 * 0.02
    assert len(out) == 20 * 6 and not out.duplicated(["criterion_id", "sample_order"]).any()


def test_the_limit_of_an_executor_is_shared_by_its_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert asking.calls_per_task(spark, 8 * cores) == 8 and asking.calls_per_task(spark, 1) == 1


def test_a_stopped_run_asks_only_what_is_left(spark, monkeypatch):
    questions, notes, ledger, rule = _questions(spark, 40), _folder(), _folder() + "/replies", _rules()

    def noting(q):
        with open(f"{notes}/{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(f"{q['unit_key']} {q['sample_order']}\n")
        return rule(q["criterion_id"], q["sample_order"])

    append, stored = ST.append, []

    def stops(*a):
        if stored:
            raise KeyboardInterrupt
        stored.append(append(*a))

    with monkeypatch.context() as m:  # the second of four jobs is not stored
        m.setattr(ST, "append", stops)
        with pytest.raises(KeyboardInterrupt):
            asking.collect_by_calls(questions, noting, 3, 10, ledger=ledger, jobs=4)
    kept = ST.read_store(spark, ledger).count()
    assert 0 < kept < 120
    asking.collect_by_calls(questions.where("criterion_id <> 4"), noting, 3, 10, ledger=ledger)
    done = ST.read_store(spark, ledger)
    assert done.select(*SM.REPLY_KEY).distinct().count() == done.count()
    got = asking.collect_by_calls(questions.where("criterion_id <> 4"), lambda q: 1 / 0, 3, 10, ledger=ledger)  # asks nothing
    assert {r.status for r in got.collect()} == {"complete"} and ST.read_store(spark, ledger).count() == done.count()


def test_no_questions(spark):
    got = asking.collect_by_calls(_questions(spark, 3).where(F.lit(False)), lambda q: "yes")
    assert got.count() == 0 and {"response", "status", "n_samples"} <= set(got.columns)
