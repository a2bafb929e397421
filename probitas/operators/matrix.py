"""Matrices of any width as blocks of columns, made from a long table without a list of columns on the driver.

The columns are numbered by a global ordinal of their sorted names; block ``b`` holds columns ``b * width`` to
``(b + 1) * width - 1``. A block's row is an array of its cells, so the schema does not grow with the matrix, tasks hold
at most ``width`` cells of a row, and blocks are written side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.operators.graph import with_ordinal

WIDTH = 500  # columns of a block


def block_columns(long: DataFrame, column: str, width: int = WIDTH) -> DataFrame:
    """(name, block, place): every distinct, not null value of ``column`` in the order of names, placed in its block from 0."""
    names = long.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()
    at = F.col("ordinal")
    return with_ordinal(names, ["name"]).select("name", F.floor(at / width).cast("int").alias("block"), (at % width).cast("int").alias("place"))


def block_headers(columns: DataFrame) -> DataFrame:
    """(block, names): the column names of every block in their order."""
    listed = columns.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("h"))
    return listed.select("block", F.col("h.name").alias("names"))


def column_blocks(long: DataFrame, columns: DataFrame, rows: list[str], column: str, value: str, width: int = WIDTH) -> DataFrame:
    """(rows..., block, cells) from ``long``, with every row in every block; a missing cell is null.

    Defined cases: null row keys are rows like any other; a null column name adds its row but no cell; of several values of one cell the least is
    taken; an empty table, or one without column names, has no blocks.
    """
    last = columns.agg(F.max(F.struct("block", "place")).alias("l")).select("l.*").first()  # two numbers
    n_blocks, n_last = (0, 0) if last["block"] is None else (last["block"] + 1, last["place"] + 1)
    cells = (long.join(columns, F.col(column) == F.col("name")).groupBy(*rows, "block", "place").agg(F.min(value).alias("value")))
    frame = (long.select(*rows).distinct()
             .select(*rows, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)) if n_blocks else F.array().cast("array<int>")).alias("block"))
             .withColumn("place", F.lit(None).cast("int")).withColumn("value", F.lit(None).cast(cells.schema["value"].dataType)))
    whole = cells.unionByName(frame).groupBy(*rows, "block").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value")))).alias("m"))
    n_cells = F.when(F.col("block") < n_blocks - 1, width).otherwise(n_last)
    return whole.select(*rows, "block", F.transform(F.sequence(F.lit(0), n_cells - 1), lambda i: F.try_element_at("m", i)).alias("cells"))


def block_cells(blocks: DataFrame, columns: DataFrame, rows: list[str]) -> DataFrame:
    """The blocks as a long table again, missing cells included: (rows..., block, place, name, value)."""
    one = blocks.select(*rows, "block", F.posexplode("cells").alias("place", "value"))
    return one.join(columns, ["block", "place"]).select(*rows, "block", "place", "name", "value")


def _quoted(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_blocks(blocks: DataFrame, columns: DataFrame, rows: list[str], path: str) -> None:
    """Write each block as one delimited file under ``path/block=<n>``: a header (row keys, then names), then the rows in the
    order of their keys. Blocks are written in parallel by as many tasks as there are."""
    names = {c: F.lit(c) for c in rows}
    head = block_headers(columns).select("block", F.lit(0).alias("_kind"), *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in rows],
                                         F.concat_ws(",", *names.values(), F.array_join(F.transform("names", _quoted), ",")).alias("value"))
    body = blocks.select("block", F.lit(1).alias("_kind"), *rows,
                         F.concat_ws(",", *[_quoted(F.col(c)) for c in rows], F.array_join(F.transform("cells", _quoted), ",")).alias("value"))
    (head.unionByName(body).repartition("block").sortWithinPartitions("block", "_kind", *rows).select("block", "value")
     .write.partitionBy("block").text(path))
