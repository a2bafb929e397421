"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.session import materialize, ship_package  # noqa: F401  (re-exported)

# A key value with more than 1 / HEAVY_SHARE of all rows counts as heavy; by counting, at
# most HEAVY_SHARE such values exist, whatever the size of the input.
HEAVY_SHARE = 1000

# The white space that separates words in every contract of this subpackage, as a regex class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def lookup_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Left join to a table of one row per key without a hot task.

    ``right`` has one row per non-null ``key`` and, in ``count``, the number of left rows with that
    key. Keys with more than 1 / HEAVY_SHARE of all rows (at most HEAVY_SHARE of them) are broadcast;
    their left rows then carry random salts that match nothing, so the shuffle of the
    second join spreads them evenly. Null keys are spread the same way and match nothing.
    """
    total = right.agg(F.sum(count)).first()[0] or 0  # one number
    values = [c for c in right.columns if c != key]
    is_heavy = F.col(count) * HEAVY_SHARE > F.lit(total)
    heavy = (right.where(is_heavy)
             .select(F.col(key).alias("__hkey"), F.struct(*values).alias("__hval")))
    light = (right.where(~is_heavy)
             .select(F.lit(0).alias("__lsalt"), F.col(key).alias("__lkey"), F.struct(*values).alias("__lval")))
    spread = F.col("__hval").isNotNull() | F.col(key).isNull()
    tagged = (left.join(F.broadcast(heavy), F.col(key) == F.col("__hkey"), "left").drop("__hkey")
              .withColumn("__salt", F.when(spread, 1 + (F.rand(7) * 65536).cast("int")).otherwise(0)))
    joined = tagged.join(light, (F.col("__salt") == F.col("__lsalt")) & (F.col(key) == F.col("__lkey")), "left")
    val = F.coalesce(F.col("__hval"), F.col("__lval"))
    return joined.select(*[F.col(c) for c in left.columns], *[val[c].alias(c) for c in values])
