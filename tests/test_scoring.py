"""Scoring operators on literal rows: sample scores, adjustment rules, signed-rank test."""


from pyspark.sql import functions as F

from probitas import rules as R
from probitas.operators import adjust as A
from probitas.operators import compare as C
from probitas.operators import samples as SM
from probitas.operators import units as U


def test_sample_score_golden_table(spark):
    rows = []
    for valid in range(6):
        for yes in range(valid + 1):
            rows.append((valid, yes, yes, valid - yes, 5 - valid))
    df = spark.createDataFrame(rows, "v int, y int, n_yes long, n_no long, n_undefined long")
    got = {(r.v, r.y): (r.coherence, r.validity, r.weighted, r.mean)
           for r in SM.scores_from_counts(df).collect()}
    golden = {(0, 0): (None, 0.0, 0.0), (1, 0): (1.0, .2, .2), (2, 1): (0.0, .4, 0.0), (3, 1): (.11, .6, .07),
              (4, 1): (.25, .8, .2), (4, 2): (0.0, .8, 0.0), (5, 1): (.36, 1.0, .36), (5, 2): (.04, 1.0, .04),
              (5, 5): (1.0, 1.0, 1.0)}
    for k, v in golden.items():
        assert got[k][:3] == v, k
    assert got[(1, 0)][3] == 0.4  # one "no", four undefined: (0 + 4 * 0.5) / 5


def test_prerequisite_and_group_collapse(spark):
    rules = R.AuditRules(n_criteria=10, prerequisites={8: 7, 9: 7}, exclusive_groups={5: [5, 6, 7, 8]})
    # criteria 4..8 as in the fixture; 7 scores 0.8 -> 8 and 9 keep their scores
    scores = {0: .1, 1: .1, 2: .1, 3: .1, 4: .5, 5: .2, 6: .8, 7: .8, 8: 0.0, 9: .3}
    weights = {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 9, 6: 7, 7: 5, 8: 3, 9: 1}
    df = spark.createDataFrame([("u", c, float(s)) for c, s in scores.items()], "unit string, criterion_id int, s double")
    w = spark.createDataFrame([(c, float(x)) for c, x in weights.items()], "criterion_id int, weight double")
    out = {r.item_id: r.s_w for r in A.adjusted_weighted(df, ["unit"], ["s"], w, rules).collect()}
    assert len(out) == rules.n_items == 7
    assert abs(out[4] - .5) < 1e-12 and abs(out[5] - .8 * 7) < 1e-12 and abs(out[9] - .3) < 1e-12
    # prerequisite 7 at zero: 8 and 9 score zero whatever they were
    df0 = df.withColumn("s", F.when(F.col("criterion_id") == 7, 0.0).otherwise(F.col("s")))
    gated = {r.criterion_id: r.s for r in A.prerequisite_gate(df0, ["unit"], ["s"], rules).collect()}
    assert gated[9] == 0.0 and gated[8] == 0.0 and gated[4] == .5


def test_group_weight_lowest_index_on_tie_all_zero(spark):
    rules = R.AuditRules(n_criteria=4, prerequisites={}, exclusive_groups={0: [0, 1, 2, 3]})
    df = spark.createDataFrame([("u", c, 0.0, float(10 + c)) for c in range(4)],
                               "unit string, criterion_id int, s double, weight double")
    r = A.exclusive_group_collapse(df, ["unit"], ["s"], rules).first()
    assert r.s == 0.0 and r.s_weight == 10.0


def _signed_rank(spark, x, y):
    df = spark.createDataFrame([("u", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "unit string, item int, a double, b double")
    df = df.withColumn("d", F.col("a") - F.col("b"))
    ranked = C.with_average_rank(df, ["unit"], "d", "t")
    return ranked.groupBy("unit").agg(*C.signed_rank_aggs("d", "t")).first()


def test_signed_rank_golden(spark):
    x = [0, 1, 1, 2, 0, 3, 1, 0, 2, 4, 1, 0]
    y = [0, 0, 3, 1, 2, 1, 1, 1, 0, 1, 0, 2]
    r = _signed_rank(spark, x, y)
    assert r.t_stat == 23.5 and r.t_pvalue == 0.68


def test_signed_rank_brute_force(spark):
    """Against a direct Python computation of the same definition."""
    import math
    x = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    y = [2, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5, 9, 0, 4]
    d = [a - b for a, b in zip(x, y) if a != b]
    ad = sorted(abs(v) for v in d)
    rank = {v: (ad.index(v) + 1 + len(ad) - ad[::-1].index(v)) / 2 for v in ad}
    rp = sum(rank[abs(v)] for v in d if v > 0)
    rm = sum(rank[abs(v)] for v in d if v < 0)
    n = len(d)
    ties = sum(t ** 3 - t for t in (ad.count(v) for v in set(ad)))
    z = (rp - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    p = math.erfc(abs(z) / math.sqrt(2))
    r = _signed_rank(spark, x, y)
    assert r.t_stat == min(rp, rm)
    assert abs(r.t_pvalue - round(p, 2)) < 1e-9
    assert rp + rm == n * (n + 1) / 2


def test_signed_rank_all_zero(spark):
    r = _signed_rank(spark, [1, 2, 3], [1, 2, 3])
    assert r.t_stat == 0.0 and r.t_pvalue is None


def test_completeness_gate_idempotent(spark):
    rows = [("s", "m", k, c, 0.5) for k, n in (("a", 3), ("b", 2), ("c", 4)) for c in range(n)]
    rows.append(("s", "m", "c", 0, 0.5))  # duplicate criterion: 5 rows, 4 distinct
    df = spark.createDataFrame(rows, "scenario string, model string, unit_key string, criterion_id int, fact double")
    g = U.completeness_gate(df, 3)
    assert {r.unit_key for r in g.collect()} == {"a"}
    assert g.count() == U.completeness_gate(g, 3).count()


def test_first_n_samples_hot_group(spark):
    """One group holding most rows: the top-k still returns its first n."""
    rows = [("s", "m", "k", 0, "Fact", i, "yes") for i in range(2000)]
    rows += [("s", "m", "k", 1, "Fact", i, "" if i % 2 else "no") for i in range(10)]
    df = spark.createDataFrame(rows, "scenario string, model string, unit_key string, criterion_id int, "
                                     "question_type string, sample_order long, response string")
    got = SM.first_n_samples(df, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.criterion_id, []).append(r.sample_order)
    assert sorted(by[0]) == [0, 1, 2, 3, 4]
    assert sorted(by[1]) == [0, 2, 4, 6, 8]


def test_enumerate_units_fan_out(spark):
    countries = spark.createDataFrame(
        [("IT", "Italy", ["Italian", "German"], ["it", "de"], 0), ("AT", "Austria", ["German"], ["de"], 1)],
        "country_id string, country string, languages array<string>, language_codes array<string>, ord int")
    units = U.enumerate_units(countries, ["m1", "m2"])
    assert units.count() == 3 * 2 * 3
    lang = units.where(F.col("scenario") == R.SCENARIO_LANGUAGE).where(F.col("unit_key") == "de")
    assert lang.select("country_id").distinct().count() == 2  # the German file meets both countries
    keys = {r.unit_key for r in units.where(F.col("scenario") == R.SCENARIO_LANGUAGE_COUNTRY).collect()}
    assert keys == {"it_IT", "de_IT", "de_AT"}


def test_gate_drops_hot_incomplete_unit(spark):
    """A unit holding most of the rows (duplicated criteria) is dropped by the
    partial-count gate; the complete units are unaffected."""
    rules = R.AuditRules(n_criteria=4, prerequisites={}, exclusive_groups={})
    ok = [("s", "m", k, c, 0.5, 0.5, 0.5) for k in ("a", "b") for c in range(4)]
    hot = [("s", "m", "hot", i % 4, 1.0, 1.0, 0.0) for i in range(20000)]
    schema = "scenario string, model string, unit_key string, criterion_id int, fact double, support double, " \
             "opposition double"
    items = spark.createDataFrame(ok + hot, schema)
    weights = spark.createDataFrame([(c, 25.0) for c in range(4)], "criterion_id int, weight double")
    totals = {r.unit_key: r.fact_total for r in C.weighted_totals(items, weights, rules).collect()}
    assert totals == {"a": 50.0, "b": 50.0}


def test_every_question_is_asked_until_it_has_enough_replies(spark):
    """One question answers at once, one late, one never; nothing is asked more often than needed."""
    asked = spark.sparkContext.accumulator(0)

    def responder(batches):
        for pdf in batches:
            asked.add(len(pdf))
            late = (pdf["full_prompt"] == "late") & (pdf["sample_order"] < 8)
            yield pdf.assign(response=["" if l or p == "never" else ("yes" if k % 2 else " \u00a0yes.")
                                       for l, p, k in zip(late, pdf["full_prompt"], pdf["sample_order"])])
    rows = [("s", "m", "u", i, "Fact", p) for i, p in enumerate(["now", "late", "never"])]
    prompts = spark.createDataFrame(rows, "scenario string, model string, unit_key string, criterion_id int, question_type string, full_prompt string")
    got = SM.collect_samples(prompts, responder, n=5, max_attempts=20).collect()
    by = {p: sorted((r.sample_order or 0, r.sample_no, r.n_samples, r.status) for r in got if r.full_prompt == p) for p in ("now", "late", "never")}
    assert [r[0] for r in by["now"]] == [1, 2, 3, 4, 5] and {r[3] for r in by["now"]} == {"complete"}
    assert [r[0] for r in by["late"]] == [8, 9, 10, 11, 12] and {r[2] for r in by["late"]} == {5}
    assert by["never"] == [(0, None, 0, "short")]
    assert asked.value == 5 + 12 + 20


def test_unknown_labels_are_reported(spark):
    rows = [("s", "m", "u", 0, "Fact", a) for a in ("yes", "no", "perhaps", None)]
    df = spark.createDataFrame(rows, "scenario string, model string, unit_key string, criterion_id int, question_type string, answer string")
    r = SM.sample_scores(df).first()
    assert (r.n_samples, r.n_yes, r.n_no, r.n_undefined, r.n_unknown, r["mean"]) == (4, 1, 1, 0, 2, 0.5)


def test_question_product_is_spread(spark):
    """A scenario is a key of three values; the product still comes out of many partitions."""
    from pyspark.sql import functions as F

    from probitas.operators import questionnaire as Q
    units = spark.range(400).selectExpr("element_at(array('language_scenario', 'country_scenario'), cast(id % 2 as int) + 1) AS scenario",
                                        "concat('k', id) AS unit_key", "cast(id as int) AS country_ord", "0 AS lang_pos",
                                        "concat('C', id) AS country", "'English' AS language")
    base = spark.range(30).selectExpr("cast(id as int) AS criterion_id", "'Fact' AS question_type", "concat('Text ', id) AS text")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        q = Q.question_rows(units, base, spread=64).withColumn("p", F.spark_partition_id())
        assert q.count() == 12_000 and q.select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
