"""Collection-side tables: distinct languages, prompt table, questionnaire and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from probitas import rules as R
from probitas.functions.text import build_prompt, build_question, extract_quoted
from probitas.operators.units import country_language_pairs

# Fixed value: the English answer instruction and its tokens.
ENGLISH_PROMPT = ('Answer to the question with "yes" or "no" only.', R.YES, R.NO)


def distinct_languages(countries: DataFrame) -> DataFrame:
    """One row per language in first-seen order of (country, position) with the
    code of its first occurrence (U3, W4)."""
    pairs = country_language_pairs(countries)
    first = F.struct("country_ord", "lang_pos")
    return (pairs.groupBy("language")
            .agg(F.min(first).alias("first_seen"), F.min_by("language_code", first).alias("language_code"))
            .select("language", "language_code", F.col("first_seen.country_ord").alias("first_country_ord"),
                    F.col("first_seen.lang_pos").alias("first_lang_pos")))


def prompt_table(languages: DataFrame, candidates: DataFrame) -> DataFrame:
    """One instruction per language (J13): English is fixed; every other language
    takes its first candidate translation by (conv_id, turn) and the first two
    quoted tokens in it as yes / no. ``status`` reports languages without a
    translation or without two tokens."""
    # pick by ids first: only the chosen texts travel, and only their tokens are extracted
    ids = candidates.groupBy("language").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    chosen = candidates.join(F.broadcast(ids.select("language", "first.conv_id", "first.turn")), ["language", "conv_id", "turn"])
    first = (chosen.groupBy("language").agg(F.min("prompt").alias("prompt"))
             .withColumn("_t", extract_quoted("prompt")))
    joined = languages.join(first, "language", "left")
    english = F.col("language") == R.ENGLISH
    n = F.size(F.col("_t"))
    return joined.select(
        "language", "language_code",
        F.when(english, F.lit(ENGLISH_PROMPT[0])).otherwise(F.col("prompt")).alias("prompt"),
        F.when(english, F.lit(ENGLISH_PROMPT[1])).when(n >= 2, F.element_at("_t", 1)).alias("yes"),
        F.when(english, F.lit(ENGLISH_PROMPT[2])).when(n >= 2, F.element_at("_t", 2)).alias("no"),
        F.when(english, F.lit("ok")).when(F.col("prompt").isNull(), F.lit("missing"))
        .when(n >= 2, F.lit("ok")).otherwise(F.lit("no_tokens")).alias("status"))


def questionnaire_units(units: DataFrame) -> DataFrame:
    """One (country, language) per (scenario, unit_key): the first in enumeration
    order writes the questionnaire, later ones reuse it (first writer wins)."""
    first = F.struct("country_ord", "lang_pos", "country", "language")
    return (units.groupBy("scenario", "unit_key").agg(F.min(first).alias("f"))
            .select("scenario", "unit_key", F.col("f.country").alias("country"),
                    F.col("f.language").alias("language")))


def dealt_units(units: DataFrame, spread: int | None = None) -> DataFrame:
    """``questionnaire_units`` dealt by their keys to ``spread`` parts, at most the number of shuffle partitions (the default).

    The units are few and small next to the questions made of them, so parts that are merged by their size would put
    them, and then all questions, into a task or two. These stay as they are dealt (hence before the grouping, which needs no
    other exchange), and so do the questions of a unit.
    """
    most = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(spread or most, most)
    return questionnaire_units(units.repartition(parts, "scenario", "unit_key"))


def question_rows(units: DataFrame, base_questions: DataFrame, spread: int | None = None) -> DataFrame:
    """Every base question for every unit key of every scenario, with its text.

    The product is the result itself. The items, which the questionnaire bounds, go to all parts of :func:`dealt_units`,
    so nothing of the product is moved, sorted or held.
    """
    return (dealt_units(units, spread).crossJoin(F.broadcast(base_questions))
            .select("scenario", "unit_key", "country", "language", "criterion_id", "question_type",
                    build_question("text", "scenario", "country", "language").alias("question")))


def build_questionnaire(units: DataFrame, base_questions: DataFrame) -> DataFrame:
    """Questions of every questionnaire (J12): each English item, for each unit key
    of each scenario, built by ``build_question``; one row per (scenario,
    unit_key, criterion_id) with the three question types as columns.

    The items get their types as columns before they meet the units: a question is its lower-cased text behind words of
    the unit, so the greatest text of a type is the greatest question in every unit.
    """
    items = base_questions.groupBy("criterion_id").pivot("question_type", R.QUESTION_TYPES).agg(F.max(F.lower("text")))
    return (dealt_units(units).crossJoin(F.broadcast(items))
            .select("scenario", "unit_key", "criterion_id",
                    *[build_question(t, "scenario", "country", "language").alias(t.lower()) for t in R.QUESTION_TYPES]))


def prompt_language(scenario, language):
    """Instruction language of a unit: English in the country scenario."""
    return F.when(F.col(scenario) == R.SCENARIO_COUNTRY, F.lit(R.ENGLISH)).otherwise(F.col(language))


def build_prompts(questionnaire: DataFrame, units: DataFrame, prompts: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Full prompt per (scenario, unit_key, criterion_id, question_type): question and
    the instruction of the unit's prompt language (T5, J11). Missing questions
    are dropped (never sent as text) and counted: ``dropped`` observes ``questions`` and ``questions_dropped``
    in the pass that builds the prompts.

    Units meet their instruction first. Of the join with the questions, which are many times as many, only the units are
    held by hash; questions still dealt as :func:`dealt_units` has dealt their units are not moved again."""
    instr = prompts.where(F.col("status") == "ok").select(F.col("language").alias("prompt_language"), "prompt")
    keys = (dealt_units(units).withColumn("prompt_language", prompt_language("scenario", "language"))
            .join(instr, "prompt_language").select("scenario", "unit_key", "prompt_language", "prompt"))
    long = questionnaire.select("scenario", "unit_key", "criterion_id", F.explode(F.array(*[
        F.struct(F.lit(t).alias("question_type"), F.col(t.lower()).alias("question"))
        for t in R.QUESTION_TYPES])).alias("q")).select("scenario", "unit_key", "criterion_id", "q.*")
    if dropped is not None:
        long = long.observe(dropped, F.count(F.lit(1)).alias("questions"),
                            F.coalesce(F.sum(F.col("question").isNull().cast("long")), F.lit(0)).alias("questions_dropped"))
    long = long.where(F.col("question").isNotNull())
    return (long.join(keys.hint("shuffle_hash"), ["scenario", "unit_key"])
            .select("scenario", "unit_key", "criterion_id", "question_type", "prompt_language",
                    build_prompt("question", "prompt").alias("full_prompt")))
