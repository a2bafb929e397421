"""Score adjustment: stance, prerequisite gate, exclusive-group collapse, weighting,
and the wide-to-long truth reshape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.functions.numeric import np_round
from probitas.rules import AuditRules


def stance_score(support="support", opposition="opposition") -> Column:
    """Stance from the two stance questions: (support + (1 - opposition)) / 2."""
    s = F.col(support) if isinstance(support, str) else support
    o = F.col(opposition) if isinstance(opposition, str) else opposition
    return (s + (F.lit(1.0) - o)) / F.lit(2.0)


def stance_score_rounded(support="support", opposition="opposition") -> Column:
    """Stance as stored at collection time: mean(support, |opposition - 1|), 2 dp."""
    s = F.col(support) if isinstance(support, str) else support
    o = F.col(opposition) if isinstance(opposition, str) else opposition
    return np_round((s + F.abs(o - F.lit(1.0))) / F.lit(2.0), 2)


def unpivot_truth(wide: DataFrame, id_cols: list[str], prefix: str = "crit_") -> DataFrame:
    """Wide truth (one column per criterion) to long (ids..., criterion_id, score)."""
    value_cols = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(id_cols, value_cols, "criterion", "score")
    return long.select(*id_cols,
                       F.substring("criterion", len(prefix) + 1, 10).cast("int").alias("criterion_id"),
                       F.col("score").cast("double").alias("score"))


def prerequisite_gate(df: DataFrame, unit_cols: list[str], score_cols: list[str], rules: AuditRules) -> DataFrame:
    """A criterion scores 0 unless its required criterion scores > 0 in the same unit.

    The required ids are a bounded rule list, so each becomes one windowed
    ``max(when(criterion_id = req, score))`` over the unit (units are complete,
    hence bounded) -- no self-join.
    """
    if not rules.prerequisites:
        return df
    unit_w = Window.partitionBy(*unit_cols)
    required = sorted(set(rules.prerequisites.values()))
    out = df
    for sc in score_cols:
        for r in required:
            out = out.withColumn(f"_req_{sc}_{r}", F.max(F.when(F.col("criterion_id") == r, F.col(sc))).over(unit_w))
        gated = F.col(sc)
        for cid, r in sorted(rules.prerequisites.items()):
            gated = F.when((F.col("criterion_id") == cid) & ~(F.coalesce(F.col(f"_req_{sc}_{r}"), F.lit(0.0)) > 0),
                           F.lit(0.0)).otherwise(gated)
        out = out.withColumn(sc, gated)
    return out.drop(*[f"_req_{sc}_{r}" for sc in score_cols for r in required])


def exclusive_group_collapse(df: DataFrame, unit_cols: list[str], score_cols: list[str],
                             rules: AuditRules, weight_col: str = "weight") -> DataFrame:
    """Collapse each exclusive group to one item with the group's max score.

    The item's weight is the weight of the lowest criterion id that reaches the
    max (``max_by`` over (score, -criterion_id)). Output: unit_cols, item_id and,
    per score column, ``<score>`` and ``<score>_weight``.
    """
    groups = rules.group_table(df.sparkSession)
    tagged = (df.join(groups, "criterion_id", "left")
              .withColumn("item_id", F.coalesce("group_id", "criterion_id")))
    aggs = []
    for sc in score_cols:
        aggs.append(F.max(sc).alias(sc))
        aggs.append(F.max_by(F.col(weight_col), F.struct(F.col(sc), -F.col("criterion_id"))).alias(f"{sc}_weight"))
    return tagged.groupBy(*unit_cols, "item_id").agg(*aggs)


def adjusted_weighted(df: DataFrame, unit_cols: list[str], score_cols: list[str], weights: DataFrame,
                      rules: AuditRules) -> DataFrame:
    """Prerequisite gate, weight lookup, group collapse, score x weight.

    Returns unit_cols, item_id and ``<score>_w`` per score column.
    """
    gated = prerequisite_gate(df, unit_cols, score_cols, rules)
    weighted = gated.join(weights.select("criterion_id", "weight"), "criterion_id", "inner")
    collapsed = exclusive_group_collapse(weighted, unit_cols, score_cols, rules)
    return collapsed.select(*unit_cols, "item_id",
                            *[(F.col(sc) * F.col(f"{sc}_weight")).alias(f"{sc}_w") for sc in score_cols])
