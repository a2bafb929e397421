"""Graph-pattern semantics on hand-made triples (independent of the oracle)."""

from probitas.operators import graph as G
from pyspark.sql import Observation

TRIPLES = [
    # country Q1: two official languages, one without a code; English + French demonyms
    ("Q1", "label", "Kingdom of the Netherlands", "en"), ("Q1", "P37", "L1", None), ("Q1", "P37", "L2", None),
    ("Q1", "P297", "NL", None), ("Q1", "P1549", "Dutch", "en"), ("Q1", "P1549", "Néerlandais", "fr"),
    ("L1", "label", "Dutch", "en"), ("L1", "P424", "nl", None),
    ("L2", "label", "Frisian", "en"),  # no code: the paired optional fails for L2
    # country Q2: no label (falls back to its id), no ISO code, dropped and renamed languages
    ("Q2", "P37", "L3", None), ("Q2", "P37", "L4", None), ("Q2", "P1549", "Greekish", "en"),
    ("L3", "label", "Modern Greek", "en"), ("L3", "P424", "el", None),
    ("L4", "label", "Norwegian", "en"), ("L4", "P424", "no", None),
    # country Q3: Ukraine, demonym overridden, no English demonym in the graph
    ("Q3", "label", "Ukraine", "en"), ("Q3", "P37", "L5", None), ("Q3", "P297", "UA", None),
    ("L5", "label", "Ukrainian", "en"), ("L5", "P424", "uk", None),
    # Q4 is not in the subject list
    ("Q4", "label", "Elsewhere", "en"),
]


def test_bindings_and_rules(spark):
    triples = spark.createDataFrame(TRIPLES, "subject string, predicate string, object string, lang string")
    subjects = spark.createDataFrame([("Q1",), ("Q2",), ("Q1",), ("Q3",)], "subject string")
    b = {(r.country, r.language): r for r in G.country_bindings(triples, subjects).collect()}
    assert set(b) == {("Q1", "L1"), ("Q2", "L3"), ("Q2", "L4"), ("Q3", "L5")}  # repeats don't multiply; no L2
    assert b[("Q1", "L1")].citizenship == "Dutch"              # English demonym only
    assert b[("Q2", "L3")].country_label == "Q2"               # label falls back to the id
    assert b[("Q2", "L3")].country_code is None                # optional ISO code
    norm = {(r.country_name, r.language_name): r for r in G.normalize_names(G.country_bindings(triples, subjects))
            .collect()}
    assert ("Netherlands", "Dutch") in norm                    # renamed country
    assert ("Q2", "Greek") in norm and ("Q2", "Norwegian") not in norm  # renamed / dropped languages
    assert norm[("Ukraine", "Ukrainian")].citizenship == "Ukraininan"   # demonym override
    rows = G.complete_bindings(G.normalize_names(G.country_bindings(triples, subjects)))
    lists = {r.country: r for r in G.collect_country_languages(rows).collect()}
    assert set(lists) == {"Netherlands", "Ukraine"}            # Q2 lacks an ISO code -> skipped
    assert lists["Netherlands"].languages == "Dutch" and lists["Netherlands"].country_id == "NL"
    counts = G.language_counts(G.normalize_names(G.country_bindings(triples, subjects))).first()
    assert (counts.n_language_rows, counts.n_countries, counts.n_skipped_rows) == (2, 2, 1)


def test_language_lists_first_wins(spark):
    rows = spark.createDataFrame(
        [("X", "Xish", "B-lang", "b", "XX"), ("X", "Xish", "A-lang", "a", "XX"), ("X", "Xish", "A-lang", "a", "XX"),
         ("X", "Xish", "A-lang", "a2", "XX")],
        "country_name string, citizenship string, language_name string, language_code string, country_code string")
    r = G.collect_country_languages(rows).first()
    assert r.languages == "A-lang|A-lang|B-lang" and r.language_codes == "a|a2|b" and r.n_languages == 3


def test_first_seen_order_and_crosswise_repeats(spark):
    seen = [("X", "Xish", "B", "b", "XX"), ("Y", "Yish", "B", "b", "YY"), ("X", "Xer", "A", "a", "X2"), ("X", "Xish", "B", "a", "XX"),
            ("X", "Xish", "B", "b2", "XX"), ("X", "Xish", "A", "b2", "XX"), ("X", "Xish", "B", "b", "XX"), ("Y", "Yer", "A", "a", "Y2")]
    schema = "country_name string, citizenship string, language_name string, language_code string, country_code string, place int"
    rows = spark.createDataFrame([(*r, k) for k, r in enumerate(seen)], schema).repartition(3)
    numbered = G.with_ordinal(rows, ["place"])
    assert sorted((r.ordinal, r.place) for r in numbered.collect()) == [(k, k) for k in range(len(seen))]
    want = {}
    for name, citizenship, language, code, key in seen:  # one binding after the other
        c = want.setdefault(name, (citizenship, key, [], []))
        if not (language in c[2] and code in c[3]):
            c[2].append(language)
            c[3].append(code)
    got = {r.country: (r.citizenship, r.country_id, r.languages.split("|"), r.language_codes.split("|")) for r in G.collect_country_languages(numbered).collect()}
    assert got == want and got["X"][2] == ["B", "A", "B"]


def test_skipped_bindings_are_reported(spark):
    rows = spark.createDataFrame([("X", "Xish", "A", "a", "XX"), ("X", "Xish", None, "a", "XX"), (None, "Xish", "A", "a", "XX")],
                                 "country_name string, citizenship string, language_name string, language_code string, country_code string")
    skipped = Observation("skipped")
    assert G.complete_bindings(rows, skipped).count() == 1 and skipped.get == {"bindings": 3, "bindings_skipped": 2}
    assert G.with_ordinal(rows.limit(0), ["country_name"]).count() == 0
