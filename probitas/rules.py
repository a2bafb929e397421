"""Fixed values of the audit method and the rule tables built from them.

Everything that decides *how* scores are computed (gate width, prerequisite pairs,
exclusive groups, answer values) is a parameter held in a small rule object, so
the same operators run for the published 76-criteria questionnaire and for any
other questionnaire.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the method's published definitions).
# ---------------------------------------------------------------------------
SCENARIO_LANGUAGE = "language_scenario"
SCENARIO_COUNTRY = "country_scenario"
SCENARIO_LANGUAGE_COUNTRY = "language_country_scenario"
SCENARIOS = [SCENARIO_LANGUAGE, SCENARIO_COUNTRY, SCENARIO_LANGUAGE_COUNTRY]

FACT = "Fact"
SUPPORT = "Support"
OPPOSITION = "Opposition"
STANCE = "Stance"
QUESTION_TYPES = [FACT, SUPPORT, OPPOSITION]

YES = "yes"
NO = "no"
UNDEFINED = "undefined"
# value of one sample answer in the sample mean
ANSWER_VALUE = {YES: 1.0, NO: 0.0, UNDEFINED: 0.5}
SAMPLES_PER_QUESTION = 5
SIGNIFICANCE_LEVEL = 0.05

# Models in their reporting order, and their display labels.
MODEL_LIST = [
    "Qwen/Qwen3.5-2B", "Qwen/Qwen3.5-9B", "Qwen/Qwen3.5-27B", "meta-llama/Llama-3.2-3B",
    "meta-llama/Llama-3.1-8B", "meta-llama/Llama-3.1-70B", "deepseek-chat", "claude-sonnet-4-6",
    "gpt-5.4", "gemini-3-flash-preview",
]
MODEL_LABEL = {
    "Qwen/Qwen3.5-2B": "Qwen 2B", "Qwen/Qwen3.5-9B": "Qwen 9B", "Qwen/Qwen3.5-27B": "Qwen 27B",
    "meta-llama/Llama-3.2-3B": "LlaMA 3B", "meta-llama/Llama-3.1-8B": "LlaMA 8B",
    "meta-llama/Llama-3.1-70B": "LlaMA 70B", "deepseek-chat": "DeepSeek", "claude-sonnet-4-6": "Sonnet",
    "DeepL": "DeepL", "gpt-5.4": "GPT", "gemini-3-flash-preview": "Gemini",
}

# Published questionnaire: 76 criteria, 60 gates 61 and 62, 25..28 form one item.
PUBLISHED_N_CRITERIA = 76
PUBLISHED_PREREQUISITES = {61: 60, 62: 60}
PUBLISHED_EXCLUSIVE_GROUPS = {25: [25, 26, 27, 28]}

# Language left out of the back-translation average.
BACKTRANSLATION_EXCLUDED_LANGUAGE = "Montenegrin"
# Countries written with an article in generated questions.
COUNTRIES_WITH_ARTICLE = ["United Kingdom", "Netherlands"]
# Placeholder keys of the long language/country MAE table.
NO_COUNTRY = "No Country"
ENGLISH = "English"

# Name normalising of knowledge-graph labels.
COUNTRY_RENAMES = {
    "Czech Republic": "Czechia",
    "Kingdom of the Netherlands": "Netherlands",
    "Bosnia and Herzegovina": "Bosnia & Herzegovina",
}
DROPPED_COUNTRIES = ["country of the Kingdom of the Netherlands"]
DEMONYM_OVERRIDES = {"Ukraine": "Ukraininan"}
DROPPED_LANGUAGES = ["Romansh", "Mirandese", "Abkhaz", "Nynorsk", "Norwegian"]
LANGUAGE_RENAMES = {"Modern Greek": "Greek"}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AuditRules:
    """Parameters of one questionnaire."""

    n_criteria: int = PUBLISHED_N_CRITERIA
    prerequisites: dict = field(default_factory=lambda: dict(PUBLISHED_PREREQUISITES))
    exclusive_groups: dict = field(default_factory=lambda: {k: list(v) for k, v in PUBLISHED_EXCLUSIVE_GROUPS.items()})
    samples_per_question: int = SAMPLES_PER_QUESTION

    @property
    def n_items(self) -> int:
        """Items after the exclusive groups are collapsed."""
        return self.n_criteria - sum(len(m) - 1 for m in self.exclusive_groups.values())

    def group_table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(m), int(g)) for g, members in sorted(self.exclusive_groups.items()) for m in members]
        schema = T.StructType([T.StructField("criterion_id", T.IntegerType(), False),
                               T.StructField("group_id", T.IntegerType(), False)])
        return F.broadcast(spark.createDataFrame(rows, schema))


# The 20-criteria questionnaire used over the driver's test tables: same shape of
# rules, placed at 14 (gate of 15 and 16) and 5..8 (one exclusive group).
TEST_RULES = AuditRules(n_criteria=20, prerequisites={15: 14, 16: 14}, exclusive_groups={5: [5, 6, 7, 8]})


def model_dim(spark: SparkSession, models: list[str] | None = None) -> DataFrame:
    """(model, label, ord): reporting order and display label of every model."""
    models = models or MODEL_LIST
    rows = [(m, MODEL_LABEL.get(m, m), i) for i, m in enumerate(models)]
    schema = "model STRING, label STRING, ord INT"
    return F.broadcast(spark.createDataFrame(rows, schema))
