"""Contiguous, byte-balanced shards from a global prefix sum of sizes.

The rows are ordered by id. Per-partition totals of a range-partitioned size table give each
partition its offset; a window inside each partition gives every row its global prefix, and the
prefix is cut at equal targets. Texts are read once, to be measured, and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probitas.llm.common import materialize

OVERHEAD = 8  # bytes counted for each row besides its text


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = OVERHEAD, keep: list[str] | None = None) -> DataFrame:
    """Put every row into one of ``n_shards`` contiguous shards of near-equal bytes.

    Returns ``id_col``, the columns named in ``keep`` (whole texts, say), size, text_crc32, shard, slot.
    A row goes where the middle of its byte range falls: shard ``floor(middle * n / total)``, so
    a shard's bytes differ from the target by at most one row. ``slot`` counts a shard's rows from 0.

    Defined cases: a null text has size ``overhead`` and the checksum of the empty text; null ids come first;
    rows of equal id are ordered by checksum and size, equal rows in any order (they are
    interchangeable); an empty table gives an empty result; other columns are ignored unless kept, where
    names starting with ``__`` are reserved.
    """
    kept = [c for c in (keep or []) if c != id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialize(
        docs.select(F.col(id_col).alias("__id"), (F.octet_length(text).cast("long") + overhead).alias("__size"),
                    F.crc32(text).alias("__crc"), F.monotonically_increasing_id().alias("__row"),
                    F.struct(*[F.col(c) for c in kept]).alias("__kept") if kept else F.lit(None).cast("int").alias("__kept")),
        "shard-sizes")
    order = ["__id", "__crc", "__size", "__row"]
    ranged = materialize(sized.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "shard-ranges")

    # One row per partition: its offset in bytes and rows, and the grand total.
    by_part = Window.orderBy("__part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("__part").agg(F.sum("__size").alias("__b"), F.count("*").alias("__n"))
               .select("__part", F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__b0"),
                       F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
                       F.sum("__b").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total")))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(
        ranged.withColumn("__end", F.sum("__size").over(inside)).withColumn("__nth", F.count("*").over(inside))
        .join(F.broadcast(offsets), "__part")
        .withColumn("__nth", F.col("__n0") + F.col("__nth") - 1)
        .withColumn("__twice_mid", 2 * (F.col("__b0") + F.col("__end")) - F.col("__size"))
        .withColumn("shard", F.least(F.expr(f"(__twice_mid * {n_shards}) div (2 * __total)"), F.lit(n_shards - 1)).cast("int"))
        .select("__id", "__size", "__crc", "__kept", "__nth", "shard"), "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("__nth").alias("__first"))  # at most n_shards rows
    return (placed.join(F.broadcast(firsts), "shard")
            .select(F.col("__id").alias(id_col), *[F.col("__kept")[c].alias(c) for c in kept], F.col("__size").alias("size"),
                    F.col("__crc").alias("text_crc32"), "shard", (F.col("__nth") - F.col("__first")).alias("slot")))


def write_shards(docs: DataFrame, n_shards: int, path: str, **options) -> None:
    """Write all columns of ``docs`` as Parquet under ``path``, one folder per shard, rows in slot order."""
    kept = [c for c in docs.columns if c != options.get("id_col", "doc_id")]
    out = shard_by_bytes(docs, n_shards, keep=kept, **options)
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path))
