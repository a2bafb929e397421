"""Line CRF, weak supervision, Katz backoff and the pipeline."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.katz_brute import Brute, toks

from probitas.llm import katz, line_crf, quality_rules


# ---- CRF

def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    counts, stay = np.array([4, 1, 3]), np.array([0.7, -0.3])
    odds = rng.normal(size=8)
    good, pairs, logz = line_crf.marginals(odds, counts, stay)
    for k, s in enumerate(np.cumsum(counts) - counts):
        n = counts[k]
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            score = sum(o for o, v in zip(odds[s:s + n], y) if v) + sum(stay[a] for a, b in zip(y, y[1:]) if a == b)
            weight[y] = math.exp(score)
        z = sum(weight.values())
        assert math.isclose(logz[k], math.log(z))
        for t in range(n):
            assert math.isclose(good[s + t], sum(w for y, w in weight.items() if y[t]) / z)
            if t:
                for v in (0, 1):
                    assert math.isclose(pairs[s + t, v], sum(w for y, w in weight.items() if y[t - 1] == y[t] == v) / z)


def test_gradient_points_uphill():
    texts = ["Good line here.\nAnother good line, fine.", "#### $$$$\n!!!! spam spam spam", "A calm sentence.", "spam! spam! spam!"]
    labels = np.array([1, 0, 1, 0])
    model = line_crf.fit(texts, labels, line_crf.Training(rounds=100))
    s = line_crf.scores(texts, model)
    assert (s[labels == 1] > 0.8).all() and (s[labels == 0] < 0.2).all()


def test_scores_do_not_depend_on_the_batch(odd_texts):
    model = line_crf.fit(["Fine text.\nMore of it.", "!!!! $$$$ !!!!"], np.array([1, 0]), line_crf.Training(rounds=50))
    alone = [line_crf.scores([t], model)[0] for t in odd_texts]
    assert np.allclose(line_crf.scores(odd_texts, model), alone) and all(0 <= x <= 1 for x in alone)


def test_held_out_accuracy(spark):
    import __spark_entry__ as E
    out = E.queries()["op5_line_crf"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = out.where("held_out").groupBy("quality", "predicted").count().collect()
    n = Counter({(r.quality, r.predicted): r["count"] for r in rows})
    assert n[1, 1] >= 0.99 * (n[1, 1] + n[1, 0]) and n[0, 0] >= 0.9 * (n[0, 0] + n[0, 1])


def test_classifier_cases(spark, docs, odd_texts):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs(odd_texts)
    out = line_crf.score_documents(table, labels)
    assert out.count() == len(odd_texts) and set(out.columns) == set(table.columns)
    kept = line_crf.keep_above(table, labels, 0.0)
    assert kept.columns == table.columns and kept.count() == len(odd_texts)
    none = line_crf.score_documents(table, labels.limit(0)).select("score").distinct().collect()
    assert all(math.isclose(r.score, 0.5) for r in none)
    assert line_crf.score_documents(docs([]), labels).collect() == []


# ---- weak supervision

def plain_counts(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    ws = word.findall(text or "")
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    often, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if word.search(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover),
            len(ws) < 50 or 100 * len(cover) > 50 * len(ws))


def test_counts_and_base_rule(docs, odd_texts):
    rng = random.Random(3)
    texts = odd_texts + [" ".join(rng.choices("ab", k=n)) for n in (2, 3, 4, 9, 60)] + ["a b c\n\na b c\r\n \na b c", "#*$%&|<>! é # x"]
    out = {r.doc_id: r for r in quality_rules.judge_quality(docs(texts), keep=["doc_id"]).collect()}
    for k, t in enumerate(texts):
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(t), t
        assert not (r.kept and r.base_failed)


def voted(n, share_bad, noise, n_rules=8, seed=4):
    """Votes on documents of which some have one of three faults; two rules see each fault. The last rule votes bad on a
    share of all documents, whatever they are."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        fault = rng.randrange(3) if rng.random() < share_bad else None
        votes = [2 if rng.random() < 0.95 else 0 for _ in range(n_rules)]
        if fault is not None:
            votes[2 * fault] = votes[2 * fault + 1] = 1
        if rng.random() < noise:
            votes[-1] = 1
        rows.append((fault is None, tuple(votes)))
    return rows


def test_expectation_maximisation_tells_faults_from_good_documents():
    rows = voted(3000, 0.2, 0.0)
    model = quality_rules.fit(dict(Counter(v for _, v in rows)), 8)
    assert np.mean([(model.beliefs(v)[0] >= 0.5) == good for good, v in rows]) > 0.98
    assert all(a > 0.8 for a in model.accuracies()[:6]) and math.isclose(sum(model.beliefs((0,) * 8)), 1)


@pytest.mark.parametrize("noise", [0.01, 0.05, 0.1, 1 / 3])
def test_a_harmless_rule_rejects_no_document_that_others_call_good(noise):
    rows = voted(6000, 0.15, noise, seed=6)
    model = quality_rules.fit(dict(Counter(v for _, v in rows)), 8)
    assert all((model.beliefs(v)[0] >= 0.5) == good for good, v in rows)
    assert abs(model.rates[0][-1][quality_rules.BAD] - noise) < 0.02


def test_a_rule_that_one_fault_trips_may_also_have_a_habit():
    """The first rule sees a fault together with the second, and alone it accuses a twentieth of the good documents."""
    rng = random.Random(8)
    rows = [(good, tuple(1 if j == 0 and rng.random() < 0.05 else v for j, v in enumerate(votes))) for good, votes in voted(6000, 0.15, 0.0)]
    model = quality_rules.fit(dict(Counter(v for _, v in rows)), 8)
    assert all((model.beliefs(v)[0] >= 0.5) == good for good, v in rows)


def test_quality_expression_equals_the_model(spark):
    model = quality_rules.fit({(2, 2): 90, (1, 2): 5, (2, 1): 4, (0, 2): 3, (1, 0): 2}, 2)
    rows = list(itertools.product(range(3), repeat=2))
    out = spark.createDataFrame(rows, "a int, b int").withColumn("q", model.posterior(["a", "b"])).collect()
    assert all(math.isclose(r.q, model.beliefs((r.a, r.b))[0], rel_tol=1e-9) for r in out)


def test_rules_catch_junk_and_keep_clean(spark):
    import __spark_entry__ as E
    out = E.queries()["op7_weak_supervision"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    n = Counter({(r.quality, r.kept): r["count"] for r in out.where("not base_failed").groupBy("quality", "kept").count().collect()})
    assert n[1, True] >= 0.99 * (n[1, True] + n[1, False]) and n[0, False] >= 0.9 * (n[0, True] + n[0, False])


def test_rules_cases(docs, odd_texts):
    table = docs(odd_texts)
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} <= {k for k, t in enumerate(odd_texts) if not plain_counts(t)[-1]}
    assert quality_rules.judge_quality(docs([])).collect() == [] and quality_rules.keep_good(docs([])).collect() == []


# ---- Katz

def katz_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "Zz", "a" * 150, "b" * 150]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for _ in range(n)]


def test_katz_against_dictionaries(docs, odd_texts, monkeypatch):
    texts = katz_texts(1, 150) + odd_texts + ["never seen words here w1", "w1 unknown w2"]
    table = docs(texts).repartition(4)
    trains = F.col("doc_id") % 3 != 1
    out = {r.doc_id: r for r in katz.score_documents(table, trains).collect()}
    model = Brute([t for k, t in enumerate(texts) if k % 3 != 1])
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        r, w = out[k], toks(t)
        assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (k % 3 != 1, len(w), sum(x in model.c for x in w), model.n)
        assert math.isclose(r.base_score, model.base(t), rel_tol=1e-9) and math.isclose(r.score, model.score(t), rel_tol=1e-9, abs_tol=1e-9)


def test_backoff_weights_normalise_exactly():
    model = Brute(katz_texts(2, 80))
    for h in [("<start>", 0), *list(model.c)[:20]]:
        assert math.isclose(sum(model.p(h, w) for w in [*model.c, "<unseen>"]), 1, rel_tol=1e-9)


def test_discounts():
    d = katz.Discounts.fit([0, 1000, 400, 220, 140, 100, 75])
    assert all(0 < x < r for r, x in enumerate(d.taken) if r) and d.of(np.array([0, 1, 9, 10 ** 6])).tolist() == [0, d.taken[1], d.taken[5], d.taken[5]]
    assert katz.Discounts.fit([0] * 7).taken[1:] == (0.5,) * 5


def test_katz_cases(docs):
    nothing = katz.score_documents(docs(["a b", None]), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nothing)
    odd = katz.score_documents(docs(["a b", "a b", "a"], [None, 4, 4]), F.when(F.col("doc_id") == 4, True)).collect()
    assert sorted((str(r.doc_id), r.trained) for r in odd) == [("4", True), ("4", True), ("None", False)]
    assert katz.score_documents(docs([]), F.lit(True)).collect() == []


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P

    from probitas.session import materialize
    sf = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    ids, docs = None, source
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf), "stage")
        if k < len(P.STAGES) - 1:
            assert docs.columns == source.columns
            new = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids is None or new <= ids
            ids = new
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids
    con = duckdb.connect()
    junk = con.execute(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE quality = 0").fetchall()
    assert sum(j in ids for j, in junk) <= 0.1 * len(junk)


def test_pipeline_on_odd_rows(spark, docs, odd_texts):
    import corpus_pipeline as P

    from probitas.session import materialize
    for texts in (odd_texts, []):
        table = docs(texts)
        for _, stage in P.STAGES:
            table = materialize(stage(spark, table, "/root/testdata/sf0.001"), "stage")
        table.collect()
