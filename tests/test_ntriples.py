"""N-Triples files: terms, language tags, datatypes, escapes, comments and broken lines."""

import tempfile

from probitas.sources.ntriples import scan_ntriples, write_ntriples
from pyspark.sql import functions as F


def test_scan(spark):
    root = tempfile.mkdtemp(prefix="probitas-nt-", dir="/tmp")
    with open(f"{root}/a.nt", "w", encoding="utf-8") as f:
        f.write('# comment\n\n<http://e/Q1> <http://e/label> "Land"@en .\n<http://e/Q1> <http://e/P37> <http://e/L1> . # note\n'
                '_:b1 <http://other/p> "a \\"b\\" \\\\n c\\n\\u00e9 \\U0001F642 \\\\U0001F642 it\\\'s\tx"@pt-BR .\n'
                '<http://e/Q1> <http://e/n> "5"^^<http://www.w3.org/2001/XMLSchema#int> .\n<http://e/Q1> <http://e/empty> "" .\nnot a triple\n'
                '<http://e/Q1> <http://e/label> "open .\n')
    triples, broken = scan_ntriples(spark, root, "http://e/")
    assert sorted(map(tuple, triples.collect()), key=repr) == sorted([
        ("Q1", "label", "Land", "en"), ("Q1", "P37", "L1", None),
        ("_:b1", "http://other/p", 'a "b" \\n c\né \U0001F642 \\U0001F642 it\'s\tx', "pt-BR"),
        ("Q1", "n", "5", None), ("Q1", "empty", "", None)], key=repr)
    assert sorted(r.line for r in broken.collect()) == ['<http://e/Q1> <http://e/label> "open .', "not a triple"]


def test_round_trip(spark):
    path = tempfile.mkdtemp(prefix="probitas-nt-", dir="/tmp") + "/out"
    rows = [("Q1", "label", 'x\\y "z"\n\t\r 漢 \U0001F642', "en"), ("Q1", "P37", "L1", None), ("Q2", "P297", "AB", None)]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, lang string")
    write_ntriples(df, F.col("predicate") == "P37", path, "http://e/")
    triples, broken = scan_ntriples(spark, path, "http://e/")
    assert sorted(map(tuple, triples.collect()), key=repr) == sorted(rows, key=repr) and broken.count() == 0
