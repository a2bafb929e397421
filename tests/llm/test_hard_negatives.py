"""Hard negatives against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probitas.llm import hard_negatives as hn


def brute(rows, anchors, n_positives, k, lower, upper):
    live = [(i, lab, [math.floor(256.0 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for ai, al, av in live:
        if not anchors(ai):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, lab, v in live if i != ai)
        positives = [(-s, i) for s, i, lab in scored if lab == al][:n_positives]
        negatives = [(-s, i) for s, i, lab in scored if lab != al]
        for p, pi in positives:
            held = [(s, i) for s, i in negatives if lower[0] * p <= lower[1] * s and upper[1] * s <= upper[0] * p][:k]
            out += [(ai, pi, r, i, p, s) for r, (s, i) in enumerate(held, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, 2, "x", "y") for i, lab, v in rows],
                                 "vec_id long, label int, embedding array<float>, score long, rank int, positives string, slots string").repartition(3)


@pytest.mark.parametrize("n_positives, k, lower", [(5, 3, (50, 100)), (1, 1, (50, 100)), (7, 40, (-300, 100))])
def test_mining_equals_brute_force(spark, monkeypatch, n_positives, k, lower):
    monkeypatch.setattr(hn, "CELL_ROWS", 16)
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", 3)
    rng = np.random.default_rng(n_positives)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 5)) if i % 3 else 4, [float(np.float32(x)) for x in centres[rng.integers(0, 6)] + 0.3 * rng.normal(size=8)])
            for i in range(260)]
    rows += [(1000 + i, 3, rows[5][2]) for i in range(60)] + [(2000 + i, 2, rows[5][2]) for i in range(10)]  # ties
    rows += [rows[7], rows[7], (50, 1, rows[9][2])]                                                          # repeated rows and ids
    rows += [(None, 1, rows[0][2]), (300, None, rows[0][2]), (350, 1, None), (400, 1, [None] * 8), (450, 1, [float("nan")] * 8),
             (500, 2, [float("inf")] * 8), (550, 2, []), (600, 1, [0.0] * 8), (650, 1, rows[3][2][:4]), (700, 99, rows[3][2]), (-50, 2, rows[3][2])]
    random.Random(4).shuffle(rows)
    got = hn.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, n_positives, k, lower).collect()
    want = brute(rows, lambda i: i % 10 == 0, n_positives, k, lower, (95, 100))
    assert len(want) > 30 and sorted(map(tuple, got)) == want


def test_empty_and_without_partners(spark):
    mine = lambda rows: hn.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert mine([]) == []
    assert mine([(0, 1, [1.0]), (1, 2, [1.0])]) == []                       # no positive
    assert mine([(0, 1, [1.0]), (1, 1, [1.0])]) == []                       # no negative
    assert mine([(1, 1, [1.0]), (2, 1, [1.0])]) == []                       # no anchor
    assert [tuple(r) for r in mine([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.99])])] == [(0, 1, 1, 2, 65536, 58880)]


def test_large_components_stay_exact():
    a = np.array([[2 ** 30, 3]], "<i4")
    b = np.array([[2 ** 30, 1], [2 ** 30, 2]], "<i4")
    s = hn.products(a, b)
    assert s.tolist() == [[2 ** 60 + 3, 2 ** 60 + 6]]
    assert [x.tolist() for x in hn.top(s * 4, np.array([5, 6]), 1)] == [[0], [1]]
