"""Registered text, questionnaire and translation-quality queries (with DuckDB oracles)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from probitas import rules as R
from probitas.functions import numeric as NU
from probitas.functions import text as TX
from probitas.operators import asking
from probitas.operators import questionnaire as Q
from probitas.operators import samples as SM
from probitas.operators import rollups as RU
from probitas.operators import translation as TR
from probitas.plans import sql_inputs as S
from probitas.plans import sql_text as ST
from probitas.plans.inputs import Inputs
from probitas.plans.registry import register
from probitas.plans.sample_queries import _prompts
from probitas.session import materialize, stage_path
from probitas.sources import driver_tables as D
from probitas.sources import io as IO
from probitas.sources import store as STORE


@register("clean_text", S.with_inputs(f"SELECT doc_id, {ST.clean_sql('reply')} AS cleaned FROM replies",
                                      ST.cte_reply_texts()))
def clean_text(spark, sf_dir):
    """Translation extracted from whole model replies: Note cut, markup, label, longest line."""
    return D.reply_texts(spark, sf_dir).select("doc_id", TX.clean_text("reply").alias("cleaned"))


@register("extract_answer_text", S.with_inputs(
    f"SELECT conv_id, turn, {ST.extract_answer_sql('output')} AS answer FROM outputs", ST.cte_model_outputs()))
def extract_answer_text(spark, sf_dir):
    """Answer part of raw generations: after the last chatbot marker, special tokens removed."""
    return D.model_outputs(spark, sf_dir).select("conv_id", "turn", TX.extract_answer_text("output").alias("answer"))


_QUOTED_SQL = S.with_inputs(
    "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_quoted, CASE WHEN len(t) >= 2 THEN t[1] END AS yes, "
    "CASE WHEN len(t) >= 2 THEN t[2] END AS no, CASE WHEN len(t) >= 2 THEN 'ok' ELSE 'error' END AS status "
    f"FROM (SELECT doc_id, {ST.quoted_sql('text')} AS t FROM qtexts)", ST.cte_quoted_texts())


@register("extract_quoted", _QUOTED_SQL)
def extract_quoted(spark, sf_dir):
    """First two quoted tokens (five quote styles) of whole texts as yes / no; error row if fewer (T4)."""
    t = D.quoted_texts(spark, sf_dir).withColumn("t", TX.extract_quoted("text"))
    n = F.size("t")
    return t.select("doc_id", n.alias("n_quoted"),
                    F.when(n >= 2, F.element_at("t", 1)).alias("yes"), F.when(n >= 2, F.element_at("t", 2)).alias("no"),
                    F.when(n >= 2, F.lit("ok")).otherwise(F.lit("error")).alias("status"))


@register("remap_language_code", S.with_inputs(
    f"SELECT doc_id, lang, {ST.remap_sql('lang', 'text')} AS target_code FROM documents"))
def remap_language_code(spark, sf_dir):
    """Machine-translation target code per document language."""
    d = D.read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", TX.remap_language_code("lang", "text").alias("target_code"))


_QUNITS = f"""qunits AS (
  SELECT scenario, unit_key, f.country AS country, f.language AS language FROM (
    SELECT scenario, unit_key, first(struct_pack(country := country, language := language)
           ORDER BY country_ord, lang_pos, country, language) AS f FROM units GROUP BY ALL))"""
_QLONG = f"""qlong AS (
  SELECT q.scenario, q.unit_key, b.criterion_id, b.question_type,
         {ST.build_question_sql('b.text', 'q.scenario', 'q.country', 'q.language')} AS question
  FROM (SELECT *, unnest({S.lst(R.SCENARIOS)}) AS scenario FROM base_q) b JOIN qunits q USING (scenario))"""


def _qsql(body: str, *extra: str) -> str:
    return S.with_inputs(body, S.cte_countries(), S.cte_pairs(), S.cte_units(), ST.cte_base_questions(), _QUNITS,
                         _QLONG, *extra)


@register("build_question", _qsql("SELECT * FROM qlong"))
def build_question(spark, sf_dir):
    """Question text per item and unit key: article for some countries, scenario rules."""
    inp = Inputs.of(spark, sf_dir)
    rows = Q.question_rows(inp.units, D.base_questions(spark, sf_dir))
    return rows.select("scenario", "unit_key", "criterion_id", "question_type", "question")


_QWIDE = ("qwide AS (SELECT scenario, unit_key, criterion_id, " + ", ".join(
    f"max(CASE WHEN question_type = {S.q(t)} THEN question END) AS {t.lower()}" for t in R.QUESTION_TYPES)
    + " FROM qlong GROUP BY ALL)")


@register("build_questionnaire", _qsql("SELECT * FROM qwide", _QWIDE))
def build_questionnaire(spark, sf_dir):
    """One questionnaire per scenario key, first writer wins, question types as columns."""
    inp = Inputs.of(spark, sf_dir)
    return Q.build_questionnaire(inp.units, D.base_questions(spark, sf_dir))


@register("scan_questionnaire", _qsql("SELECT * FROM qwide", _QWIDE))
def scan_questionnaire(spark, sf_dir):
    """Questionnaires written as question files per scenario and unit key, and read back."""
    root = stage_path(spark, "questionnaires")
    IO.write_questionnaires(build_questionnaire(spark, sf_dir), root)
    return IO.scan_questionnaires(spark, root)


_BPROMPT_BODY = f"""
SELECT l.scenario, l.unit_key, l.criterion_id, l.question_type, l.prompt_language,
       concat_ws(chr(10), l.question, p.prompt) AS full_prompt
FROM (SELECT x.*, CASE WHEN x.scenario = {S.q(R.SCENARIO_COUNTRY)} THEN 'English' ELSE q.language END
             AS prompt_language
      FROM qlong x JOIN qunits q USING (scenario, unit_key) WHERE x.question IS NOT NULL) l
JOIN (SELECT language, prompt FROM prompt_table WHERE status = 'ok') p ON p.language = l.prompt_language"""
@register("scan_prompts", _qsql("SELECT language, prompt, yes, no FROM prompt_table WHERE status = 'ok'",
                                ST.cte_countries_langs(), ST.cte_prompt_table()))
def scan_prompts(spark, sf_dir):
    """The prompt document written as one JSON map and read back as rows."""
    path = stage_path(spark, "prompts_json")
    IO.write_prompts(_prompts(spark, sf_dir), path)
    return IO.scan_prompts(spark, path)


_PROMPT_SQL = _qsql(_BPROMPT_BODY, ST.cte_countries_langs(), ST.cte_prompt_table())


@register("build_prompt", _PROMPT_SQL)
def build_prompt(spark, sf_dir):
    """Full prompt: question + instruction of the unit's language, English in the country scenario."""
    inp = Inputs.of(spark, sf_dir)
    qn = Q.build_questionnaire(inp.units, D.base_questions(spark, sf_dir))
    return Q.build_prompts(qn, inp.units, _prompts(spark, sf_dir))


# Fixed test-responder rule: reply kind = (prompt length * 31 + attempt) % 5; the
# instruction's first two quoted tokens stand for yes / no.
RESPONDER_QUOTES = r'["«“]([^"»”]+)["»”][^"«“]*["«“]([^"»”]+)["»”]'
ORACLE_ATTEMPTS = 2 * R.SAMPLES_PER_QUESTION  # the rule leaves one reply in five empty, so these hold five others


def formula_responder(batches):
    """Deterministic test responder (Arrow batches in, batches out): the reply kind
    follows the prompt length and the attempt number -- the yes token, the no token
    in markup, an empty reply, a bare yes token, or a refusal."""
    import pandas as pd

    for pdf in batches:
        kind = (pdf["full_prompt"].str.len() * 31 + pdf["sample_order"]) % 5
        quoted = pdf["full_prompt"].str.extract(RESPONDER_QUOTES)
        yes = quoted[0].fillna("yes")
        no = quoted[1].fillna("no")
        resp = pd.Series(["Maybe."] * len(pdf), index=pdf.index, dtype=object)
        resp[kind == 0] = yes[kind == 0] + "."
        resp[kind == 1] = "**" + no[kind == 1] + "**"
        resp[kind == 2] = ""
        resp[kind == 3] = yes[kind == 3]
        yield pdf.assign(response=resp.astype(str))


def formula_reply(question: dict) -> str:
    """The same rule for one question at a time."""
    prompt = question["full_prompt"]
    quoted = re.search(RESPONDER_QUOTES, prompt)
    yes, no = quoted.groups() if quoted else ("yes", "no")
    return (yes + ".", f"**{no}**", "", yes, "Maybe.")[(len(prompt) * 31 + question["sample_order"]) % 5]


def _collect_sql(resumed: bool = False) -> str:
    kind = "((length(full_prompt) * 31 + sample_order) % 5)"
    yes = f"coalesce(nullif(regexp_extract(full_prompt, {S.q(RESPONDER_QUOTES)}, 1), ''), 'yes')"
    no = f"coalesce(nullif(regexp_extract(full_prompt, {S.q(RESPONDER_QUOTES)}, 2), ''), 'no')"
    attempts = f"""attempts AS (
  SELECT b.*, {S.q(D.TEST_MODELS[0])} AS model, CAST(unnest(range(1, {ORACLE_ATTEMPTS + 1})) AS INTEGER) AS sample_order
  FROM bprompts b),
samples AS (
  SELECT *, CASE WHEN {kind} = 0 THEN {yes} || '.' WHEN {kind} = 1 THEN '**' || {no} || '**'
                 WHEN {kind} = 2 THEN '' WHEN {kind} = 3 THEN {yes} ELSE 'Maybe.' END AS response
  FROM attempts)"""
    # a round asks for as many replies as are lacking, so the last attempt is the last reply that counts
    asked = (", n_asked FROM scores JOIN (SELECT scenario, model, unit_key, criterion_id, question_type, CAST(max(sample_order) AS BIGINT) AS n_asked "
             "FROM firstn GROUP BY ALL) USING (scenario, model, unit_key, criterion_id, question_type)")
    return _qsql("SELECT scenario, model, unit_key, criterion_id, question_type, n_samples, n_yes, n_no, "
                 "n_undefined, mean, coherence, validity, weighted" + (asked if resumed else " FROM scores"),
                 ST.cte_countries_langs(), ST.cte_prompt_table(), f"bprompts AS ({_BPROMPT_BODY})", attempts,
                 ST.cte_scored_samples())


@register("collect_samples", _collect_sql())
def collect_samples(spark, sf_dir):
    """Every question asked through a pluggable responder (mapInPandas) until it has 5
    non-empty replies, then scored (X1, A1-A4)."""
    inp = Inputs.of(spark, sf_dir)
    prompts = build_prompt(spark, sf_dir).withColumn("model", F.lit(D.TEST_MODELS[0]))
    got = SM.collect_samples(prompts, formula_responder)
    labelled = SM.label_samples(SM.drop_empty_responses(got), _prompts(spark, sf_dir))
    return SM.sample_scores(labelled).drop("n_unknown")


@register("resume_collection", _collect_sql(resumed=True))
def resume_collection(spark, sf_dir):
    """A collection that was stopped (half of the questions, after at most three attempts each) and is started
    again over the same ledger: the scores, and how many attempts the ledger holds of each question (J3, O5)."""
    inp = Inputs.of(spark, sf_dir)
    prompts = materialize(build_prompt(spark, sf_dir).withColumn("model", F.lit(D.TEST_MODELS[0])), "prompts")
    ledger = stage_path(spark, "ledger")
    SM.collect_samples(prompts.where("criterion_id % 2 = 0"), formula_responder, max_attempts=3, ledger=ledger)
    got = SM.collect_samples(prompts, formula_responder, ledger=ledger)
    asked = STORE.read_store(spark, ledger).groupBy(*SM.GROUP).agg(F.count(F.lit(1)).alias("n_asked"))
    labelled = SM.label_samples(SM.drop_empty_responses(got), inp.prompts)
    return SM.sample_scores(labelled).drop("n_unknown").join(asked.hint("merge"), SM.GROUP)


@register("collect_by_calls", _collect_sql(resumed=True))
def collect_by_calls(spark, sf_dir):
    """The same questions asked one by one by concurrent calls in one job, and how many attempts each took."""
    prompts = build_prompt(spark, sf_dir).withColumn("model", F.lit(D.TEST_MODELS[0]))
    ledger = stage_path(spark, "ledger")
    got = asking.collect_by_calls(prompts, formula_reply, ledger=ledger)
    asked = STORE.read_store(spark, ledger).groupBy(*SM.GROUP).agg(F.count(F.lit(1)).alias("n_asked"))
    labelled = SM.label_samples(SM.drop_empty_responses(got), _prompts(spark, sf_dir))
    return SM.sample_scores(labelled).drop("n_unknown").join(asked.hint("merge"), SM.GROUP)


def _bt_cte(name: str, where: str = "") -> str:
    return f"""{name} AS (SELECT model, language, count(*) AS n_questions,
  CAST(sum(CASE WHEN similarity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
  CASE WHEN language = 'English' THEN 1.0 ELSE {S.stable('avg(similarity)', 2)} END AS score
  FROM sims {where} GROUP BY model, language)"""


def _trans_ctes() -> list[str]:
    langs = D.LANGUAGE_ORDER
    codes = dict((l, c) for cc in D.COUNTRY_FIXTURE for l, c in cc[3])
    li = f"CAST(o.label % {len(langs)} AS INTEGER) + 1"
    pairs = f"""tpairs AS (
  SELECT {S.pick(D.TRANSLATION_SYSTEMS, 'floor(o.vec_id / 2)')} AS model, {S.lst(langs)}[{li}] AS language,
         {S.lst([codes[l] for l in langs])}[{li}] AS language_code, CAST(floor(o.vec_id / 2) AS BIGINT) AS question_id,
         o.embedding AS original, b.embedding AS back
  FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) o LEFT JOIN embeddings b ON b.vec_id = o.vec_id + 1)"""
    empty = f"(model = 'DeepL' AND {ST.remap_sql('language_code', chr(39) + 'x' + chr(39))} = '')"
    sims = f"""sims AS (SELECT model, language, question_id,
  CASE WHEN {empty} THEN 0.0 ELSE {ST.cosine_sql('original', 'back')} END AS similarity FROM tpairs)"""
    return [pairs, sims]


def _trans_sql(body: str, *extra: str) -> str:
    return S.with_inputs(body, *_trans_ctes(), _bt_cte("bt"), *extra)


@register("cosine_similarity", _trans_sql(
    f"SELECT model, language, question_id, {S.npr('similarity', 6)} AS similarity FROM sims"))
def cosine_similarity(spark, sf_dir):
    """Cosine similarity of original and back-translated sentence embeddings."""
    sims = TR.pair_similarity(D.translation_pairs(spark, sf_dir))
    return sims.select("model", "language", "question_id", NU.np_round(F.col("similarity"), 6).alias("similarity"))


@register("backtranslation_score", _trans_sql("SELECT * FROM bt"))
def backtranslation_score(spark, sf_dir):
    """Mean back-translation similarity per system and language, English = 1."""
    return TR.backtranslation_score(TR.pair_similarity(D.translation_pairs(spark, sf_dir)))


@register("avg_excluding_category", _trans_sql(
    f"SELECT model, {S.stable(f'avg(CASE WHEN language <> {S.q(R.BACKTRANSLATION_EXCLUDED_LANGUAGE)} THEN score END)', 2)}"
    " AS avg_score FROM bt GROUP BY model"))
def avg_excluding_category(spark, sf_dir):
    """Per system, mean language score leaving out Montenegrin."""
    return TR.avg_excluding_category(TR.backtranslation_score(TR.pair_similarity(D.translation_pairs(spark, sf_dir))))


_BT_LANGS = list(D.LANGUAGE_ORDER)


@register("backtranslation_matrix", _trans_sql(
    "SELECT model, " + ", ".join(f"max(CASE WHEN language = {S.q(l)} THEN score END) AS {RU.slug(l)}"
                                 for l in _BT_LANGS) + " FROM bt GROUP BY model"))
def backtranslation_matrix(spark, sf_dir):
    """System x language back-translation matrix without the average column."""
    scores = TR.backtranslation_score(TR.pair_similarity(D.translation_pairs(spark, sf_dir)))
    return TR.backtranslation_matrix(scores, _BT_LANGS)
