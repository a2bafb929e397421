"""DuckDB SQL mirrors of the sample / text adapters and text functions (oracle side)."""

from __future__ import annotations

from probitas import rules as R
from probitas.functions import text as TX
from probitas.operators.questionnaire import ENGLISH_PROMPT
from probitas.plans.sql_inputs import lst, npr, pick, q
from probitas.sources import driver_tables as D


def strip_sql(x: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in TX.WHITESPACE)
    return f"trim({x}, {chars})"


def normalize_sql(resp: str, yes: str, no: str) -> str:
    cleaned = f"replace(replace(replace(lower({resp}), '.', ''), '*', ''), '\"', '')"
    tok = f"regexp_replace(regexp_extract({cleaned}, {q(TX.FIRST_TOKEN)}, 1), '^[,;:!?.]+|[,;:!?.]+$', '', 'g')"
    return (f"CASE WHEN {tok} <> '' AND {tok} = lower({yes}) THEN 'yes' "
            f"WHEN {tok} <> '' AND {tok} = lower({no}) THEN 'no' ELSE 'undefined' END")


def clean_sql(text: str) -> str:
    t = strip_sql(f"coalesce({text}, '')")
    t = (f"(SELECT CASE WHEN contains(lower(_s), 'note:') THEN regexp_replace(_s, {q('(?is)' + TX.NOTE_CUT[4:] + '.*')}, '')"
         f" ELSE _s END FROM (SELECT {t} AS _s))")
    t = f"regexp_replace({t}, {q(TX.MARKUP)}, '', 'g')"
    t = f"regexp_replace({t}, {q(TX.LEADING_LABEL)}, '')"
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {strip_sql('l')}), lambda l: l <> '')"
    kept = f"list_filter(_lines, lambda l: NOT regexp_matches(l, {q(TX.COMMENTARY_LINE)}))"
    pool = f"(CASE WHEN len({kept}) > 0 THEN {kept} ELSE _lines END)"
    longest = (f"list_reduce({pool}, lambda acc, l: CASE WHEN length(l) > length(acc) THEN l ELSE acc END, "
               f"{pool}[1])")
    return f"(SELECT CASE WHEN len(_lines) = 0 THEN '' ELSE {longest} END FROM (SELECT {lines} AS _lines))"


def extract_answer_sql(text: str) -> str:
    t = f"string_split({text}, {q(TX.CHATBOT_MARK)})[-1]"
    for m in TX.END_MARKS:
        t = f"replace({t}, {' || chr(10) || '.join(q(p) for p in m.split(chr(10)))}, '')"
    t = f"regexp_replace({t}, {q(TX.SPECIAL_TOKEN)}, '', 'g')"
    return strip_sql(t)


def quoted_sql(text: str) -> str:
    return (f"list_transform(regexp_extract_all({text}, {q('(' + TX.QUOTED + ')')}, 1), "
            f"lambda h: {strip_sql('substring(h, 2, length(h) - 2)')})")


def build_question_sql(text: str, scenario: str, country: str, language: str) -> str:
    t = f"lower({text})"
    art = f"CASE WHEN {country} IN ({', '.join(q(c) for c in R.COUNTRIES_WITH_ARTICLE)}) THEN 'the ' ELSE '' END"
    return (f"CASE WHEN {scenario} = {q(R.SCENARIO_COUNTRY)} OR {language} = {q(R.ENGLISH)} "
            f"THEN 'In ' || {art} || {country} || ', ' || {t} "
            f"WHEN {scenario} = {q(R.SCENARIO_LANGUAGE)} THEN {t} ELSE 'In ' || {country} || ', ' || {t} END")


def remap_sql(code: str, text: str) -> str:
    return (f"CASE WHEN {text} = '' OR {code} = 'cnr' THEN '' ELSE upper(CASE WHEN {code} = 'pt' THEN 'pt-pt' "
            f"WHEN {code} = 'en' THEN 'EN-GB' ELSE {code} END) END")


def cosine_sql(a: str, b: str) -> str:
    def dot(x, y):
        return (f"list_reduce(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)),"
                f" lambda s, v: s + v, 0.0)")
    na, nb = f"sqrt({dot(a, a)})", f"sqrt({dot(b, b)})"
    return f"CASE WHEN {na} > 0 AND {nb} > 0 THEN {dot(a, b)} / ({na} * {nb}) END"


# -- adapters ------------------------------------------------------------------------------------
def _tokens(kind: int, idx_of_lang: str, langs: list[str]) -> str:
    return f"{lst([D.PROMPT_TOKENS[l][kind] for l in langs])}[{idx_of_lang}]"


def cte_samples(n: int = R.TEST_RULES.n_criteria) -> str:
    units = "[" + ", ".join(f"{{'s': {q(s)}, 'k': {q(k)}, 'l': {q(l)}}}" for s, k, l in D.SAMPLE_UNITS) + "]"
    langs = list(D.PROMPT_TOKENS)
    li = f"list_position({lst(langs)}, u.l)"
    yes, no = _tokens(0, li, langs), _tokens(1, li, langs)
    k = "(event_id % 4)"
    yes_txt = (f"CASE WHEN {k} = 0 THEN '**' || upper({yes}) || '**, of course.' WHEN {k} = 1 THEN ' \u00a0' || {yes} || '\u202f!' "
               f"WHEN {k} = 2 THEN '\"' || {yes} || '.\"' || chr(10) || {no} ELSE upper({yes}) || '.' END")
    no_txt = (f"CASE WHEN {k} = 0 THEN upper({no}) || ', it does not.' WHEN {k} = 1 THEN {no} || '\u3000;' "
              f"ELSE '*' || {no} || '*' END")
    und_txt = (f"CASE WHEN {k} = 0 THEN 'Maybe ' || {yes} WHEN {k} = 1 THEN '**' "
               f"WHEN {k} = 2 THEN 'I cannot answer that.' ELSE '' END")
    resp = (f"CASE WHEN event_type IN ('purchase', 'click') THEN {yes_txt} "
            f"WHEN event_type IN ('view', 'signup') THEN {no_txt} ELSE {und_txt} END")
    return f"""ev_u AS (
  SELECT event_id, event_type, {units}[CAST(floor(user_id / 5) % {len(D.SAMPLE_UNITS)} AS INTEGER) + 1] AS u,
         {pick(D.TEST_MODELS[:4], 'user_id')} AS model FROM events),
samples AS (
  SELECT u.s AS scenario, model, u.k AS unit_key, u.l AS prompt_language,
         CAST(event_id % {n} AS INTEGER) AS criterion_id, {pick(R.QUESTION_TYPES, f'floor(event_id / {n})')} AS question_type,
         event_id AS sample_order, {resp} AS response
  FROM ev_u)"""


def cte_countries_langs() -> str:
    return """langs AS (
  SELECT language, first(language_code ORDER BY country_ord, lang_pos) AS language_code,
         min(country_ord) AS first_country_ord, first(lang_pos ORDER BY country_ord, lang_pos) AS first_lang_pos
  FROM pairs GROUP BY language)"""


def cte_prompt_table() -> str:
    langs = [l for l in D.LANGUAGE_ORDER if l != R.ENGLISH]
    i = f"CAST(conv_id % {len(langs)} AS INTEGER) + 1"
    s = f"CAST(conv_id % {len(D.QUOTE_STYLES)} AS INTEGER) + 1"
    o = f"{lst([a for a, _ in D.QUOTE_STYLES])}[{s}]"
    c = f"{lst([b for _, b in D.QUOTE_STYLES])}[{s}]"
    yes, no = _tokens(0, i, langs), _tokens(1, i, langs)
    return f"""tprompts AS (
  SELECT {lst(langs)}[{i}] AS language, conv_id, turn,
         'Answer with ' || {o} || {yes} || {c} || ' or ' || {o} || {no} || {c} || ' only. ' || text AS prompt
  FROM conversations WHERE role = 'assistant'),
tp_first AS (
  SELECT language, prompt, {quoted_sql('prompt')} AS _t FROM tprompts
  QUALIFY row_number() OVER (PARTITION BY language ORDER BY conv_id, turn) = 1),
prompt_table AS (
  SELECT l.language, l.language_code,
         CASE WHEN l.language = 'English' THEN {q(ENGLISH_PROMPT[0])} ELSE f.prompt END AS prompt,
         CASE WHEN l.language = 'English' THEN 'yes' WHEN len(f._t) >= 2 THEN f._t[1] END AS yes,
         CASE WHEN l.language = 'English' THEN 'no' WHEN len(f._t) >= 2 THEN f._t[2] END AS no,
         CASE WHEN l.language = 'English' THEN 'ok' WHEN f.prompt IS NULL THEN 'missing'
              WHEN len(f._t) >= 2 THEN 'ok' ELSE 'no_tokens' END AS status
  FROM langs l LEFT JOIN tp_first f USING (language))"""


def cte_scored_samples(n: int = R.SAMPLES_PER_QUESTION) -> str:
    """samples -> kept -> first-n -> labelled -> scores."""
    grp = "scenario, model, unit_key, criterion_id, question_type"
    return f"""kept AS (SELECT * FROM samples WHERE response IS NOT NULL AND regexp_matches(response, {q(TX.NOT_BLANK)})),
firstn AS (
  SELECT *, row_number() OVER (PARTITION BY {grp} ORDER BY sample_order) AS sample_no FROM kept
  QUALIFY sample_no <= {n}),
labelled AS (
  SELECT f.*, {normalize_sql('f.response', 'p.yes', 'p.no')} AS answer
  FROM firstn f LEFT JOIN prompt_table p ON p.language = f.prompt_language),
counts AS (
  SELECT {grp}, count(*) AS n_samples, CAST(sum(CASE WHEN answer = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS n_yes,
         CAST(sum(CASE WHEN answer = 'no' THEN 1 ELSE 0 END) AS BIGINT) AS n_no,
         CAST(sum(CASE WHEN answer = 'undefined' THEN 1 ELSE 0 END) AS BIGINT) AS n_undefined
  FROM labelled GROUP BY ALL),
{scores_from_counts_sql('counts', 'scores', n)}"""


def scores_from_counts_sql(src: str, name: str, n: int = R.SAMPLES_PER_QUESTION) -> str:
    valid = "CAST(n_yes + n_no AS DOUBLE)"
    p = f"(CAST(n_yes AS DOUBLE) / {valid})"
    coh = f"(CASE WHEN {valid} > 0 THEN 1.0 - 4.0 * {p} * (1.0 - {p}) END)"
    val = f"({valid} / {float(n)})"
    mean = (f"((CAST(n_yes AS DOUBLE) * 1.0 + CAST(n_no AS DOUBLE) * 0.0 + CAST(n_undefined AS DOUBLE) * 0.5) "
            f"/ CAST(n_yes + n_no + n_undefined AS DOUBLE))")
    return f"""{name} AS (
  SELECT *, {npr(mean, 2)} AS mean, {npr(coh, 2)} AS coherence, {npr(val, 2)} AS validity,
         coalesce({npr(f'{coh} * {val}', 2)}, 0.0) AS weighted
  FROM {src})"""


def cte_reply_texts() -> str:
    k = "(doc_id % 8)"
    nl = "chr(10)"
    return f"""replies AS (
  SELECT doc_id, CASE WHEN {k} = 0 THEN 'Translation: ' || text || {nl} || 'Note: this is a comment'
    WHEN {k} = 1 THEN '**' || text || '**' WHEN {k} = 2 THEN '\u2028\u00a0' || text || '\u3000'
    WHEN {k} = 3 THEN 'Here is the explanation' || {nl} || text WHEN {k} = 4 THEN ''
    WHEN {k} = 5 THEN 'Note: ' || text WHEN {k} = 6 THEN text || ' Note:x tail'
    ELSE '_' || text || '_' || {nl} || 'comment: short' END AS reply
  FROM documents)"""


def cte_model_outputs() -> str:
    k = "((conv_id + turn) % 4)"
    return f"""outputs AS (
  SELECT conv_id, turn, CASE WHEN {k} = 0 THEN 'system<|CHATBOT_TOKEN|>' || text || '<|im_end|><|endoftext|>'
    WHEN {k} = 1 THEN '\u202f' || text || '\u00a0<|x|>'
    WHEN {k} = 2 THEN 'a<|CHATBOT_TOKEN|>b<|CHATBOT_TOKEN|> ' || text || ' <|im_end|>' || chr(10) || '<|endoftext|>'
    ELSE text END AS output
  FROM conversations)"""


def cte_quoted_texts() -> str:
    styles = [('"', '"'), ("«", "»"), ("“", "”"), ("‘", "’"), ("'", "'")]
    k = "CAST(doc_id % 6 AS INTEGER)"
    o = f"{lst([a for a, _ in styles])}[{k} + 1]"
    c = f"{lst([b for _, b in styles])}[{k} + 1]"
    w1 = "string_split(text, ' ')[1]"
    w2 = "coalesce(string_split(text, ' ')[2], 'x')"
    return f"""qtexts AS (
  SELECT doc_id, CASE WHEN {k} = 5 THEN text ELSE
    'Reply ' || {o} || {w1} || {c} || ' or ' || {o} || '\u00a0' || {w2} || '\u2028' || {c} || ': ' || text END AS text
  FROM documents)"""


def cte_base_questions() -> str:
    return f"""base_q AS (
  SELECT CAST(floor(item_id / 3) AS INTEGER) AS criterion_id, {pick(R.QUESTION_TYPES, 'item_id')} AS question_type,
         text FROM benchmark)"""
