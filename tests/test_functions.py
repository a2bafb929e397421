"""Column functions on literal rows (golden values of FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from probitas.functions import numeric as NU
from probitas.functions import text as TX


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


def test_np_round_matches_array_rule(spark):
    import numpy as np
    vals = [0.575, 0.125, 2.5, 2.675, 1.005, 0.655, 12.345, -0.125]
    df = spark.createDataFrame([(v,) for v in vals], ["x"])
    got = [r[0] for r in df.select(NU.np_round("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    assert got[:2] == [0.57, 0.12]
    assert one(spark, NU.np_round(F.lit(2.5), 0)) == 2.0
    assert one(spark, NU.np_round(F.lit(3.5), 0)) == 4.0


def test_to_double_nulls_bad_values(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), (None,)], ["x"])
    assert [r[0] for r in df.select(NU.to_double("x")).collect()] == [1.5, None, None, None]


def test_erfc_polynomial_close_to_math(spark):
    for x in (0.0, 0.3, 1.0, 2.5):
        assert abs(NU.erfc_nonneg_py(x) - math.erfc(x)) < 2e-7
        assert abs(one(spark, NU.erfc_nonneg(F.lit(x))) - math.erfc(x)) < 2e-7


def test_normalize_answer_goldens(spark):
    cases = [("**Yes**, of course.", "yes"), ("  no!", "no"), ("yes\nno", "yes"), ("Maybe yes", "undefined"),
             ("**", "undefined"), ("", "undefined"), (None, "undefined"), ('"JA."', "yes")]
    df = spark.createDataFrame([(r, "yes" if i != 7 else "ja", "no") for i, (r, _) in enumerate(cases)],
                               "r string, y string, n string")
    got = [x[0] for x in df.select(TX.normalize_answer("r", "y", "n")).collect()]
    assert got == [e for _, e in cases]


def test_clean_text_goldens(spark):
    cases = [("Translation: abc\nlong line here\nan explanation of it which is long", "long line here"),
             ("Note: x", "x"), ("foo Note:bar", "foo"), ("ab\ncd", "ab"), ("comment only", "comment only"),
             ("Në shqip: po *tani*", "po tani"), ("", ""), (None, "")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    got = [x[0] for x in df.select(TX.clean_text("t")).collect()]
    assert got == [e for _, e in cases]


def test_extract_answer_text_goldens(spark):
    cases = [("a<|CHATBOT_TOKEN|>b<|CHATBOT_TOKEN|> yes <|im_end|><|endoftext|>", "yes"), ("no <|x|>", "no")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    assert [x[0] for x in df.select(TX.extract_answer_text("t")).collect()] == ["yes", "no"]


def test_extract_quoted_goldens(spark):
    df = spark.createDataFrame([('Vastake ainult "jah" või "ei".',), ("Répondez par «oui» ou « non »",),
                                ("no quotes",)], "t string")
    got = [x[0] for x in df.select(TX.extract_quoted("t")).collect()]
    assert got == [["jah", "ei"], ["oui", "non"], []]


def test_build_question_rules(spark):
    rows = [("Is X?", "country_scenario", "Netherlands", "Dutch", "In the Netherlands, is x?"),
            ("Is X?", "language_scenario", "Italy", "Italian", "is x?"),
            ("Is X?", "language_scenario", "United Kingdom", "English", "In the United Kingdom, is x?"),
            ("Is X?", "language_country_scenario", "Netherlands", "Dutch", "In Netherlands, is x?")]
    df = spark.createDataFrame(rows, "t string, s string, c string, l string, e string")
    got = df.select(TX.build_question("t", "s", "c", "l").alias("q"), "e").collect()
    assert all(r["q"] == r["e"] for r in got)


def test_remap_language_code(spark):
    df = spark.createDataFrame([("pt", "x"), ("en", "x"), ("de", "x"), ("cnr", "x"), ("de", "")], "c string, t string")
    assert [r[0] for r in df.select(TX.remap_language_code("c", "t")).collect()] == ["PT-PT", "EN-GB", "DE", "", ""]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(TX.cosine_similarity("a", "b")).collect()]
    assert abs(got[0] - 0.8) < 1e-9 and got[1] is None


def test_unicode_white_space_as_python_knows_it(spark):
    raw = ["Oui\u00a0!", "Oui\u202f!", "\u00a0Oui.", "oui\u3000non", "\u2028 oui", "\x1coui\x85", "non\u2009;", "\u00a0\u3000", "oui,non"]

    def plain(r):  # the rule in plain Python
        words = r.lower().replace(".", "").replace("*", "").replace('"', "").split()
        first = words[0].strip(",;:!?.") if words else ""
        return {"oui": "yes", "non": "no"}.get(first, "undefined")
    df = spark.createDataFrame([(i, r, "oui", "non") for i, r in enumerate(raw)], "i int, r string, y string, n string")
    got = {x.i: x for x in df.select("i", TX.normalize_answer("r", "y", "n").alias("a"), TX.strip_ws("r").alias("s"),
                                     TX.extract_answer_text("r").alias("t")).collect()}
    for i, r in enumerate(raw):
        assert (got[i].a, got[i].s, got[i].t) == (plain(r), r.strip(), r.strip())


def test_rounding_as_python_does(spark):
    import random
    rng = random.Random(1)
    xs = [48.265, 2.675, 1.115, 0.5, 0.125, 0.375, 2.5, -2.675, -0.125, 0.0, 99.995, 1e-9, 12345.675, 1 / 3]
    xs += [rng.randint(0, 20_000) / 200 for _ in range(300)] + [rng.uniform(-100, 100) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 2, 4):
        got = [r.y for r in df.select(NU.py_round("x", digits).alias("y")).collect()]
        assert got == [float(round(x, digits)) for x in xs]
