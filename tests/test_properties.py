"""Property checks on many random cases at once (one Spark job each)."""

import math
import random

from pyspark.sql import functions as F

from probitas.operators import compare as C
from probitas.operators import samples as SM


def _brute_signed_rank(x, y):
    d = [round(a - b, 10) for a, b in zip(x, y)]
    d = [v for v in d if v != 0]
    n = len(d)
    if n == 0:
        return 0.0, None, 0.0, 0.0
    ad = sorted(abs(v) for v in d)
    first = {}
    for i, v in enumerate(ad):
        first.setdefault(v, i + 1)
    count = {v: ad.count(v) for v in set(ad)}
    rank = {v: first[v] + (count[v] - 1) / 2 for v in count}
    rp = sum(rank[abs(v)] for v in d if v > 0)
    rm = sum(rank[abs(v)] for v in d if v < 0)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t ** 3 - t for t in count.values()) / 48
    p = math.erfc(abs((rp - n * (n + 1) / 4) / math.sqrt(var)) / math.sqrt(2)) if var > 0 else None
    return min(rp, rm), p, rp, rm


def test_signed_rank_random_vectors(spark):
    rng = random.Random(7)
    rows, cases = [], {}
    for case in range(60):
        n = rng.choice([1, 2, 5, 17, 73])
        levels = rng.choice([3, 6, 50])  # few levels -> many ties and zeros
        x = [rng.randrange(levels) / 4 for _ in range(n)]
        y = [rng.randrange(levels) / 4 for _ in range(n)]
        cases[case] = (x, y)
        rows += [(case, i, a, b) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "case int, item int, a double, b double").withColumn(
        "d", C.np_round(F.col("a") - F.col("b"), 10))
    ranked = C.with_average_rank(df, ["case"], "d", "t")
    got = {r.case: r for r in ranked.groupBy("case").agg(
        *C.signed_rank_aggs("d", "t"),
        F.sum(F.when(F.col("d") > 0, F.col("t_rank"))).alias("rp"),
        F.sum(F.when(F.col("d") < 0, F.col("t_rank"))).alias("rm"),
        F.sum(F.when(F.col("d") != 0, 1).otherwise(0)).alias("n")).collect()}
    for case, (x, y) in cases.items():
        stat, p, rp, rm = _brute_signed_rank(x, y)
        r = got[case]
        assert r.t_stat == round(stat, 2), case
        assert (p is None and r.t_pvalue is None) or abs(r.t_pvalue - round(p, 2)) <= 0.01 + 1e-9, case
        assert (r.rp or 0) + (r.rm or 0) == r.n * (r.n + 1) / 2  # ranks of the non-zero d sum to n(n+1)/2


def test_sample_scores_ranges(spark):
    rows = [(y, n, u) for y in range(6) for n in range(6) for u in range(6) if 0 < y + n + u]
    df = spark.createDataFrame(rows, "n_yes long, n_no long, n_undefined long")
    for r in SM.scores_from_counts(df).collect():
        assert 0.0 <= r.mean <= 1.0
        assert r.coherence is None or 0.0 <= r.coherence <= 1.0
        assert r.weighted <= r.validity + 1e-12
        if r.n_yes + r.n_no == 0:
            assert r.coherence is None and r.weighted == 0.0

