"""Registered sample-level and collection-side queries (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probitas import rules as R
from probitas.operators import questionnaire as Q
from probitas.operators import samples as SM
from probitas.plans import sql_inputs as S
from probitas.plans import sql_text as ST
from probitas.plans.inputs import Inputs
from probitas.plans.registry import register
from probitas.session import materialize, stage_path
from probitas.sources import driver_tables as D
from probitas.streaming import expiring as X

GRP = "scenario, model, unit_key, criterion_id, question_type"


def _prompts(spark, sf_dir):
    """The staged prompt table of the session (built by ``prompt_table`` once)."""
    return Inputs.of(spark, sf_dir).prompts


def _sql(body: str, *extra: str) -> str:
    return S.with_inputs(body, S.cte_countries(), S.cte_pairs(), ST.cte_countries_langs(), ST.cte_prompt_table(),
                         ST.cte_samples(), ST.cte_scored_samples(), *extra)


@register("distinct_languages", S.with_inputs("SELECT * FROM langs", S.cte_countries(), S.cte_pairs(),
                                              ST.cte_countries_langs()))
def distinct_languages(spark, sf_dir):
    """Distinct languages in first-seen order with their first code."""
    return Q.distinct_languages(Inputs.of(spark, sf_dir).countries)


@register("prompt_table", _sql("SELECT * FROM prompt_table"))
def prompt_table(spark, sf_dir):
    """Answer instruction and yes / no tokens per language, English fixed, status per row."""
    inp = Inputs.of(spark, sf_dir)
    return Q.prompt_table(Q.distinct_languages(inp.countries), D.translated_prompts(spark, sf_dir))


@register("normalize_answer", _sql(
    f"SELECT s.scenario, s.model, s.unit_key, s.criterion_id, s.question_type, s.sample_order, "
    f"{ST.normalize_sql('s.response', 'p.yes', 'p.no')} AS answer FROM samples s "
    f"LEFT JOIN prompt_table p ON p.language = s.prompt_language"))
def normalize_answer(spark, sf_dir):
    """yes / no / undefined for every raw sample response."""
    lab = SM.label_samples(Inputs.of(spark, sf_dir).samples, _prompts(spark, sf_dir))
    return lab.select("scenario", "model", "unit_key", "criterion_id", "question_type", "sample_order", "answer")


@register("drop_empty_responses", _sql(f"SELECT {GRP}, sample_order FROM kept"))
def drop_empty_responses(spark, sf_dir):
    """Samples left after missing / blank responses are dropped."""
    kept = SM.drop_empty_responses(Inputs.of(spark, sf_dir).samples)
    return kept.select(*SM.GROUP, "sample_order")


@register("first_n_samples", _sql(f"SELECT {GRP}, sample_order, sample_no FROM firstn"))
def first_n_samples(spark, sf_dir):
    """First 5 non-empty samples per (unit, criterion, question type); top-k limited before the shuffle."""
    return SM.first_n_samples(Inputs.of(spark, sf_dir).samples).select(*SM.GROUP, "sample_order",
                                                                     F.col("sample_no").cast("bigint"))


def _scores(spark, sf_dir):
    inp = Inputs.of(spark, sf_dir)
    return SM.sample_scores(SM.label_samples(SM.first_n_samples(inp.samples), _prompts(spark, sf_dir)))


@register("sample_mean", _sql(f"SELECT {GRP}, n_samples, n_yes, n_no, n_undefined, mean FROM scores"))
def sample_mean(spark, sf_dir):
    """Mean of the first 5 answers (yes 1, no 0, undefined 0.5), 2 dp (A1)."""
    return _scores(spark, sf_dir).select(*SM.GROUP, "n_samples", "n_yes", "n_no", "n_undefined", "mean")


@register("sample_coherence", _sql(f"SELECT {GRP}, coherence, validity, weighted FROM scores"))
def sample_coherence(spark, sf_dir):
    """Coherence 1-4p(1-p), validity n_valid/5 and their product (A2, A3, A4)."""
    return _scores(spark, sf_dir).select(*SM.GROUP, "coherence", "validity", "weighted")


def _answer_rows_sql(src: str) -> str:
    def col(t, c):
        return f"max(CASE WHEN question_type = {S.q(t)} THEN {c} END)"
    sup, opp = col(R.SUPPORT, "mean"), col(R.OPPOSITION, "mean")
    return (f"SELECT scenario, model, unit_key, criterion_id, {col(R.FACT, 'mean')} AS fact, {sup} AS support, "
            f"{opp} AS opposition, {S.npr(f'({sup} + abs({opp} - 1.0)) / 2.0', 2)} AS stance, "
            f"{col(R.FACT, 'coherence')} AS fact_coherence, {col(R.FACT, 'validity')} AS fact_validity, "
            f"{col(R.FACT, 'weighted')} AS fact_weighted, {col(R.OPPOSITION, 'coherence')} AS stance_coherence, "
            f"{col(R.OPPOSITION, 'validity')} AS stance_validity, {col(R.OPPOSITION, 'weighted')} AS stance_weighted "
            f"FROM {src} GROUP BY scenario, model, unit_key, criterion_id")


@register("answer_rows", _sql(_answer_rows_sql("scores")))
def answer_rows(spark, sf_dir):
    """Answer-file rows from sample scores; stance trio from Opposition samples."""
    return SM.answer_rows(_scores(spark, sf_dir))


@register("incremental_scores", _sql(
    f"SELECT {GRP}, n_samples, n_yes, n_no, n_undefined, mean, coherence, validity, weighted FROM scores"))
def incremental_scores(spark, sf_dir):
    """Scores after three unequal arrivals, the middle part of the samples last: equal to
    scoring all samples at once (I1, U2)."""
    samples, prompts = Inputs.of(spark, sf_dir).samples, _prompts(spark, sf_dir)
    low, high = samples.agg(F.min("sample_order"), F.max("sample_order")).first()
    a, b = low + (high - low) // 4, low + (high - low) // 2
    order = F.col("sample_order")
    arrivals = [samples.where(order < a), samples.where(order >= b), samples.where((order >= a) & (order < b))]
    stored = scored = None
    for new in arrivals:
        if stored is None:
            stored = materialize(SM.first_n_samples(new), "first-samples")
            scored = materialize(SM.sample_scores(SM.label_samples(stored, prompts)), "scores")
        else:
            scored = materialize(SM.incremental_scores(scored, stored, new, prompts), "scores")
            stored = materialize(SM.first_n_samples(stored.select(*new.columns).unionByName(new)), "first-samples")
    return scored.drop("n_unknown")


@register("streaming_scores", _sql(
    f"SELECT {GRP}, n_samples, n_yes, n_no, n_undefined, mean, coherence, validity, weighted FROM scores"))
def streaming_scores(spark, sf_dir):
    """Scores by a stream over two arrivals, the later samples first; the second query has a new checkpoint, starts from the open groups
    of the first one's table, and forgets groups that are quiet: equal to scoring all samples at once (I1)."""
    samples, prompts = Inputs.of(spark, sf_dir).samples, _prompts(spark, sf_dir)
    low, high = samples.agg(F.min("sample_order"), F.max("sample_order")).first()
    early = F.col("sample_order") < low + (high - low) // 3
    out = stage_path(spark, "changed-groups")
    for k, new in enumerate([samples.where(~early), samples.where(early)]):
        source, checkpoint = stage_path(spark, "arrivals"), stage_path(spark, "stream-checkpoint")
        new.write.parquet(f"{source}/{k}")
        X.run_expiring(spark, f"{source}/*", samples.schema, prompts, out, checkpoint, idle_seconds=3600.0 * k or None)
    return X.current_scores(X.read_changes(spark, out)).drop("n_unknown")
