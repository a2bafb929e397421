"""Domain inputs of one data directory, and the staged comparison table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from probitas import rules as R
from probitas.operators.adjust import unpivot_truth
from probitas.operators.compare import comparison_table
from probitas.operators.units import enumerate_units
from probitas.session import materialize
from probitas.sources import driver_tables as D
from probitas.stages import Owner


class Inputs:
    """Domain tables over the driver tables in ``sf_dir``.

    Each stand-in table is derived once per session and state of the input files and written to the
    checkpoint folder as Parquet, like the stored tables a deployment reads; all
    queries of the session then scan those files (column pruning and filter
    pushdown apply, and a lost executor re-reads files instead of recomputing).
    The tables belong to this object's owner: :meth:`release` deletes them, no query does.
    """

    _cache: dict[tuple, list["Inputs"]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, rules: R.AuditRules = R.TEST_RULES):
        self.spark, self.sf_dir, self.rules = spark, sf_dir, rules
        self.owner = Owner(spark, f"inputs of {sf_dir}", [sf_dir])

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, rules: R.AuditRules = R.TEST_RULES) -> "Inputs":
        """The tables of ``sf_dir`` as its files are now. Frames made before a change keep their tables until they are released."""
        states = cls._cache.setdefault((spark.sparkContext.applicationId, sf_dir, repr(rules)), [])
        if not states or states[-1].owner.changed():
            states.append(cls(spark, sf_dir, rules))
        return states[-1]

    @classmethod
    def release(cls, spark: SparkSession, sf_dir: str) -> None:
        """Delete what was staged for ``sf_dir`` in this session, in all its states."""
        for key in [k for k in cls._cache if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
            for inputs in cls._cache.pop(key):
                inputs.owner.release()

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        with self.owner:
            return materialize(df, name)

    @cached_property
    def countries(self) -> DataFrame:
        return self._stage(D.countries(self.spark, self.sf_dir), "countries")

    @cached_property
    def units(self) -> DataFrame:
        return enumerate_units(self.countries, R.MODEL_LIST)

    @cached_property
    def item_scores(self) -> DataFrame:
        return self._stage(D.item_scores(self.spark, self.sf_dir, self.rules.n_criteria), "item_scores")

    @cached_property
    def truth_wide(self) -> DataFrame:
        return self._stage(D.truth_wide(self.spark, self.sf_dir, self.rules.n_criteria), "truth_wide")

    @cached_property
    def truth_long(self) -> DataFrame:
        return unpivot_truth(self.truth_wide, ["country_id"]).select("country_id", "criterion_id", "score")

    @cached_property
    def weights(self) -> DataFrame:
        return self._stage(D.weights(self.spark, self.sf_dir, self.rules.n_criteria), "weights")

    @cached_property
    def samples(self) -> DataFrame:
        return self._stage(D.samples(self.spark, self.sf_dir, self.rules.n_criteria), "samples")

    @cached_property
    def triples(self) -> DataFrame:
        return self._stage(D.triples(self.spark, self.sf_dir), "triples")

    @cached_property
    def prompts(self) -> DataFrame:
        """Instruction and yes / no tokens per language (the prompt table), staged once."""
        from probitas.operators.questionnaire import distinct_languages, prompt_table
        return self._stage(prompt_table(distinct_languages(self.countries),
                                        D.translated_prompts(self.spark, self.sf_dir)), "prompts")

    def comparison(self) -> DataFrame:
        return comparison_table(self.item_scores, self.truth_long, self.weights, self.units, self.rules)

    @cached_property
    def staged_comparison(self) -> DataFrame:
        return self._stage(self.comparison(), "comparison")


def staged_comparison(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    """The comparison table written once per session and state of the data directory, then re-read by every roll-up
    (the one stage boundary of the evaluation); ``again`` computes and writes it anew."""
    inputs = Inputs.of(spark, sf_dir)
    if again:
        inputs.__dict__.pop("staged_comparison", None)
    return inputs.staged_comparison
