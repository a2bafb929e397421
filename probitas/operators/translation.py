"""Translation quality by back-translation similarity (re-aimed from a hosted
similarity endpoint to an embeddings table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas import rules as R
from probitas.functions.numeric import stable_round
from probitas.functions.text import cosine_similarity, remap_language_code

MACHINE_TRANSLATION = "DeepL"


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """Cosine similarity of each original / back-translation pair (T9). A system on
    the machine-translation path whose target code maps to "" produces two empty
    translations: that pair scores 0 instead of a similarity."""
    empty = (F.col("model") == MACHINE_TRANSLATION) & (remap_language_code("language_code", F.lit("x")) == "")
    return pairs.select("model", "language", "question_id",
                        F.when(empty, F.lit(0.0)).otherwise(cosine_similarity("original", "back")).alias("similarity"))


def backtranslation_score(sims: DataFrame) -> DataFrame:
    """Mean similarity per (system, language), English fixed at 1, 2 dp; pairs
    without a similarity are skipped and counted (A20)."""
    return (sims.groupBy("model", "language").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.sum(F.when(F.col("similarity").isNull(), 1).otherwise(0)).alias("n_missing"),
        F.avg("similarity").alias("_avg"))
        .select("model", "language", "n_questions", "n_missing",
                F.when(F.col("language") == R.ENGLISH, F.lit(1.0)).otherwise(stable_round(F.col("_avg"), 2))
                .alias("score")))


def avg_excluding_category(scores: DataFrame, excluded: str = R.BACKTRANSLATION_EXCLUDED_LANGUAGE) -> DataFrame:
    """Per system: mean of the rounded language scores without one language."""
    return (scores.groupBy("model")
            .agg(stable_round(F.avg(F.when(F.col("language") != excluded, F.col("score"))), 2).alias("avg_score")))


def backtranslation_matrix(scores: DataFrame, languages: list[str]) -> DataFrame:
    """System x language matrix of the scores, without the average column."""
    from probitas.operators.rollups import slug
    cells = [F.first(F.when(F.col("language") == l, F.col("score")), ignorenulls=True).alias(slug(l))
             for l in languages]
    return scores.groupBy("model").agg(*cells)


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows of ``existing`` whose key is in ``updates`` and append new keys (U4)."""
    return existing.join(updates.select(*keys), keys, "left_anti").unionByName(updates.select(*existing.columns))


def append_missing(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Append the candidate rows whose key is absent from ``existing``."""
    return existing.unionByName(candidates.join(existing.select(*keys), keys, "left_anti")
                                .select(*existing.columns))

