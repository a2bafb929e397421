"""Sample-level operators: answer normalising, first-N selection, sample scores,
answer rows, incremental scoring and the pluggable responder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas import rules as R
from probitas.functions.numeric import np_round
from probitas.functions.text import NOT_BLANK, normalize_answer
from probitas.operators.adjust import stance_score_rounded
from probitas.operators.units import UNIT
from probitas.session import materialize, ship_package
from probitas.sources import store as ST

GROUP = UNIT + ["criterion_id", "question_type"]


def drop_empty_responses(samples: DataFrame, response: str = "response") -> DataFrame:
    """Drop missing or blank responses before samples are counted."""
    return samples.where(F.col(response).isNotNull() & F.col(response).rlike(NOT_BLANK))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group by ``order`` (column ``_rank``).

    Written as ``row_number() <= k`` so that the planner inserts a partial
    ``WindowGroupLimit`` before the shuffle: every map task forwards at most
    ``k`` rows per group, so even a group holding a third of all rows reaches
    its reducer as at most ``k`` rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def first_n_samples(samples: DataFrame, n: int = R.SAMPLES_PER_QUESTION, order: str = "sample_order",
                    keys: list[str] = GROUP) -> DataFrame:
    """First ``n`` non-empty samples per (unit, criterion, question type) in sample order."""
    kept = drop_empty_responses(samples)
    return top_k_per_group(kept, keys, [F.col(order)], n).withColumnRenamed("_rank", "sample_no")


def label_samples(samples: DataFrame, prompts: DataFrame) -> DataFrame:
    """Attach the yes / no tokens of the prompt language and normalise each response.

    ``prompts`` is (language, prompt, yes, no), one row per language.
    """
    toks = prompts.select(F.col("language").alias("prompt_language"), F.col("yes").alias("_yes"),
                          F.col("no").alias("_no"))
    return (samples.join(toks, "prompt_language", "left")
            .withColumn("answer", normalize_answer(F.col("response"), F.col("_yes"), F.col("_no")))
            .drop("_yes", "_no"))


def sample_scores(labelled: DataFrame, n_expected: int = R.SAMPLES_PER_QUESTION,
                  keys: list[str] = GROUP) -> DataFrame:
    """Per group: counts, mean (yes 1, no 0, undefined 0.5), coherence 1 - 4p(1-p)
    over the valid answers, validity n_valid / n_expected and their product (A1-A4).

    Labels other than yes, no and undefined take no part in the scores; ``n_unknown`` reports them. All three scores are functions of the yes / no / undefined counts, so this is
    a plain partial aggregation.
    """
    a = F.col("answer")
    counts = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.when(a == R.YES, 1).otherwise(0)).alias("n_yes"),
        F.sum(F.when(a == R.NO, 1).otherwise(0)).alias("n_no"),
        F.sum(F.when(a == R.UNDEFINED, 1).otherwise(0)).alias("n_undefined"),
        F.sum(F.when(F.coalesce(a.isin(R.YES, R.NO, R.UNDEFINED), F.lit(False)), 0).otherwise(1)).alias("n_unknown"))
    return scores_from_counts(counts, n_expected)


def scores_from_counts(counts: DataFrame, n_expected: int = R.SAMPLES_PER_QUESTION) -> DataFrame:
    y, n, u = F.col("n_yes"), F.col("n_no"), F.col("n_undefined")
    valid = y + n
    total = y + n + u
    p = y / valid
    coherence = F.when(valid > 0, F.lit(1.0) - F.lit(4.0) * p * (F.lit(1.0) - p))
    validity = valid / F.lit(float(n_expected))
    mean = (y * R.ANSWER_VALUE[R.YES] + n * R.ANSWER_VALUE[R.NO] + u * R.ANSWER_VALUE[R.UNDEFINED]) / total
    return counts.select(
        "*",
        np_round(mean, 2).alias("mean"),
        np_round(coherence, 2).alias("coherence"),
        np_round(validity, 2).alias("validity"),
        F.coalesce(np_round(coherence * validity, 2), F.lit(0.0)).alias("weighted"))


def answer_rows(scores: DataFrame) -> DataFrame:
    """Pivot per-type scores into answer-file rows: fact / support / opposition means,
    stored stance, and the fact and stance quality trios -- the stance trio comes
    from the Opposition samples only (A4, P6)."""
    s = scores.groupBy(*UNIT, "criterion_id").pivot("question_type", R.QUESTION_TYPES).agg(
        F.first("mean").alias("mean"), F.first("coherence").alias("coh"), F.first("validity").alias("val"),
        F.first("weighted").alias("w"))
    return s.select(
        *UNIT, "criterion_id",
        F.col(f"{R.FACT}_mean").alias("fact"), F.col(f"{R.SUPPORT}_mean").alias("support"),
        F.col(f"{R.OPPOSITION}_mean").alias("opposition"),
        stance_score_rounded(F.col(f"{R.SUPPORT}_mean"), F.col(f"{R.OPPOSITION}_mean")).alias("stance"),
        F.col(f"{R.FACT}_coh").alias("fact_coherence"), F.col(f"{R.FACT}_val").alias("fact_validity"),
        F.col(f"{R.FACT}_w").alias("fact_weighted"),
        F.col(f"{R.OPPOSITION}_coh").alias("stance_coherence"), F.col(f"{R.OPPOSITION}_val").alias("stance_validity"),
        F.col(f"{R.OPPOSITION}_w").alias("stance_weighted"))


def incremental_scores(scored: DataFrame, stored: DataFrame, new_samples: DataFrame, prompts: DataFrame,
                       n: int = R.SAMPLES_PER_QUESTION) -> DataFrame:
    """Scores after new samples have arrived, in any order: equal to scoring all samples at once.

    ``stored`` holds the samples that ``scored`` was made from, at most ``n`` per group (``first_n_samples``). The
    first ``n`` of those and the new ones are the first ``n`` of all, so only groups with new samples are scored again.
    """
    arrived = drop_empty_responses(new_samples)
    touched = arrived.select(*GROUP).distinct()
    cols = [c for c in new_samples.columns if c in stored.columns]
    merged = stored.join(touched, GROUP, "left_semi").select(*cols).unionByName(arrived.select(*cols))
    rescored = sample_scores(label_samples(first_n_samples(merged, n), prompts), n)
    return scored.join(touched, GROUP, "left_anti").unionByName(rescored.select(*scored.columns))


Responder = Callable  # Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]


REPLY_KEY = [*GROUP, "sample_order"]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Replies are many but narrow, and their files small beside the rows they hold: joins with them say how they are made, so that
# no plan takes them for a table to be sent to every task.
def open_questions(prompts: DataFrame, max_attempts: int, ledger: str | None) -> DataFrame:
    """The questions with the replies they have (``_have``), the last attempt made (``_asked``) and the last allowed (``_most``).

    Of the ledger only partitions of models and scenarios that are asked are read.
    """
    if ledger and ST.store_exists(prompts.sparkSession, ledger):
        filled = F.col("response").isNotNull() & F.col("response").rlike(NOT_BLANK)
        known = ST.lookup(prompts.sparkSession, ledger, prompts, GROUP).groupBy(*GROUP).agg(
            F.sum(F.when(filled, 1).otherwise(0)).cast("int").alias("_have"), F.max("sample_order").alias("_asked"))
        state = prompts.join(known.hint("shuffle_hash"), GROUP, "left").na.fill(0, ["_have", "_asked"])
    else:
        state = prompts.withColumn("_have", F.lit(0)).withColumn("_asked", F.lit(0))
    return state.withColumn("_most", F.col("_asked") + max_attempts)


def first_replies(questions: DataFrame, replies: DataFrame, n: int, ledger: str | None) -> DataFrame:
    """The questions, which have ``n_samples``, with their first ``n`` non-empty replies, of the ledger if there is one."""
    spark = questions.sparkSession
    if ledger and ST.store_exists(spark, ledger):
        replies = ST.lookup(spark, ledger, questions, GROUP)
    numbered = top_k_per_group(drop_empty_responses(replies), GROUP, [F.col("sample_order")], n).withColumnRenamed("_rank", "sample_no")
    return (questions.join(numbered.select(*GROUP, "sample_order", "response", "sample_no").hint("merge"), GROUP, "left")
            .withColumn("status", F.when(F.col("n_samples") >= n, "complete").otherwise("short")))


def collect_samples(prompts: DataFrame, responder: Responder, n: int = R.SAMPLES_PER_QUESTION,
                    max_attempts: int = 10 * R.SAMPLES_PER_QUESTION, ledger: str | None = None) -> DataFrame:
    """Ask a user-supplied responder until every question has ``n`` non-empty replies.

    ``prompts`` has one row per question (GROUP). The responder runs in ``mapInPandas`` and adds a string column
    ``response`` to rows that carry ``sample_order``, the number of the attempt. Each round asks only the
    questions still short, and only for as many replies as they lack; a round is a written table of attempts and
    replies, so nothing is asked twice, and the questions are written before the first one. A question that is short after ``max_attempts`` attempts is not lost: all rows carry
    ``n_samples`` and ``status`` (complete or short), and one without any reply has a row with a null response.

    ``ledger`` names a stored table of all replies, empty ones too, by question and attempt. Every round is added to it
    in one switch. A run that finds replies there goes on behind the last attempt of each question and asks only
    for what is lacking, so a run that was stopped and is started again asks and stores nothing of a finished
    round a second time. ``max_attempts`` then counts from where the run begins.
    """
    spark = prompts.sparkSession
    ship_package(spark)
    schema = T.StructType(prompts.schema.fields + [T.StructField("sample_order", T.IntegerType()), T.StructField("response", T.StringType())])
    short = materialize(open_questions(prompts, max_attempts, ledger), "asked")
    counters = ["_have", "_asked", "_most"]
    rounds, finished = [], []
    if ledger:
        start = short
        finished.append(start.where(F.col("_have") >= n).select(*prompts.columns, F.col("_have").alias("n_samples")))
        short = start.where(F.col("_have") < n)
    while True:
        upto = F.least(F.col("_asked") + n - F.col("_have"), F.col("_most"))
        asked = short.withColumn("sample_order", F.explode(F.sequence(F.col("_asked") + 1, upto))).drop(*counters)
        answers = materialize(asked.mapInPandas(responder, schema).select(*REPLY_KEY, "response"), "answers")
        if ledger:
            ST.append(answers, ledger, ["scenario", "model"])
        rounds.append(drop_empty_responses(answers))
        got = rounds[-1].groupBy(*GROUP).agg(F.count(F.lit(1)).cast("int").alias("_got"))
        state = materialize(short.withColumn("_asked", upto).join(got.hint("shuffle_hash"), GROUP, "left")
                            .withColumn("_have", F.col("_have") + F.coalesce("_got", F.lit(0))).drop("_got"), "asked")
        over = (F.col("_have") >= n) | (F.col("_asked") >= F.col("_most"))
        finished.append(state.where(over).select(*prompts.columns, F.col("_have").alias("n_samples")))
        short = state.where(~over)
        if not short.limit(1).count():
            break
    return first_replies(union(finished), union(rounds), n, ledger)
