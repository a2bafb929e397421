"""Matrices in blocks of columns, and counts merged from stored sketches."""

import csv
import glob
import tempfile

from pyspark.sql import functions as F

from probitas.operators import graph as G
from probitas.operators import matrix as M


def _matrix(long, rows, width):
    columns = M.block_columns(long, "label", width)
    return columns, M.column_blocks(long, columns, rows, "label", "value", width)


def test_blocks_hold_every_cell(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 3.0), (None, "x", 4.0), ("c", None, 5.0), ("a", "x", 0.5)],
                                 "row string, label string, value double")
    columns, blocks = _matrix(long, ["row"], 2)
    got = {(r["row"], r["block"]): r["cells"] for r in blocks.collect()}
    assert got == {("a", 0): [0.5, 2.0], ("a", 1): [None], ("b", 0): [None, None], ("b", 1): [3.0],
                   (None, 0): [4.0, None], (None, 1): [None], ("c", 0): [None, None], ("c", 1): [None]}
    assert {r["block"]: r["names"] for r in M.block_headers(columns).collect()} == {0: ["x", "y"], 1: ["z"]}
    assert M.block_cells(blocks, columns, ["row"]).count() == 4 * 3


def test_empty_tables(spark):
    long = spark.createDataFrame([], "row string, label string, value double")
    assert _matrix(long, ["row"], 2)[1].count() == 0
    no_names = spark.createDataFrame([("a", None, 1.0)], "row string, label string, value double")
    assert _matrix(no_names, ["row"], 2)[1].count() == 0


def test_twenty_thousand_labels_are_written_as_blocks(spark):
    """Every third cell of 5 rows over 20,000 labels, one of which needs quotes."""
    long = (spark.range(100_000).select((F.col("id") % 5).cast("string").alias("row"), F.floor(F.col("id") / 5).alias("n"))
            .where((F.col("n") + F.col("row").cast("int")) % 3 == 0)
            .select("row", F.when(F.col("n") == 7, 'say "7", please').otherwise(F.format_string("label %05d", "n")).alias("label"),
                    (F.col("n") * 10 + F.col("row").cast("int")).alias("value")))
    columns, blocks = _matrix(long, ["row"], M.WIDTH)
    path = tempfile.mkdtemp(prefix="probitas-blocks-", dir="/tmp") + "/m"
    M.write_blocks(blocks, columns, ["row"], path)
    want = {(r["row"], r["label"]): str(r["value"]) for r in long.collect()}
    got, files = {}, glob.glob(f"{path}/block=*/*.txt")
    assert len(files) == len(glob.glob(f"{path}/block=*")) == 40
    for f in files:
        with open(f, newline="") as text:
            head, *body = csv.reader(text)
        assert head[0] == "row" and head[1:] == sorted(head[1:]) and [b[0] for b in body] == ["0", "1", "2", "3", "4"]
        got.update({(b[0], name): v for b in body for name, v in zip(head[1:], b[1:]) if v})
    assert got == want


def test_merged_counts_are_within_the_error(spark):
    """Overlapping runs of 60,000 codes; a repeated run changes nothing, an empty one adds nothing."""
    def run(a, b):
        n = F.col("id").cast("string")
        return spark.range(a, b).select(F.concat(F.lit("c"), F.col("id") % 50).alias("country_name"), F.lit("x").alias("citizenship"), n.alias("language_name"),
                                        F.when(F.col("id") % 10 != 0, n).alias("language_code"), F.lit("y").alias("country_code"))
    root = tempfile.mkdtemp(prefix="probitas-counts-", dir="/tmp") + "/c"
    for name, part in [("1", run(0, 40_000)), ("2", run(20_000, 60_000)), ("1", run(0, 40_000)), ("3", run(0, 0))]:
        G.store_counts(part, name, root)
    got = G.merged_counts(spark, root).first()
    assert (got["n_language_rows"], got["n_skipped_rows"], got["n_countries"]) == (72_000, 8_000, 45)
    assert abs(got["n_codes"] - 54_000) <= 3 * 1.04 / 2 ** (G.SKETCH_BITS / 2) * 54_000
