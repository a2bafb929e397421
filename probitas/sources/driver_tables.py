"""Stand-in inputs built from the driver's test tables.

These functions only give rows in the schemas the operators expect; they do none
of the operators' work. Each mapping is mirrored, clause for clause, by the SQL
in ``probitas.plans.sql_inputs`` and ``sql_text`` so that the DuckDB oracle sees the same inputs.

Fixture universe (attached by region key / modulo of the driver ids):

* five countries with 1-2 languages each per group of 25 rows of ``supplier`` (one group at least), so
  units, answer rows and truth grow with the tables; a language is spoken in several countries, so
  language files fan out to all of them;
* 5 models (``l_suppkey % 5``), the last one not in the model list;
* 20 criteria with the rules of ``TEST_RULES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probitas import rules as R
from probitas.functions.numeric import np_round
from probitas.operators.adjust import stance_score_rounded

# ---------------------------------------------------------------------------
# Fixed fixture values
# ---------------------------------------------------------------------------
# region key -> (country_id, country, citizenship, [(language, code), ...])
COUNTRY_FIXTURE = [
    ("NL", "Netherlands", "Dutch", [("Dutch", "nl")]),
    ("GB", "United Kingdom", "British", [("English", "en")]),
    ("IT", "Italy", "Italian", [("Italian", "it"), ("German", "de")]),
    ("ME", "Montenegro", "Montenegrin", [("Montenegrin", "cnr"), ("Serbian", "sr")]),
    ("XK", "Kosovo", "Kosovar", [("Albanian", "sq"), ("Serbian", "sr")]),
]
TEST_MODELS = ["Qwen/Qwen3.5-2B", "meta-llama/Llama-3.1-8B", "deepseek-chat", "gpt-5.4", "gpt-5.4-mini"]
# yes / no tokens per language, as a translated prompt would carry them
PROMPT_TOKENS = {
    "English": ("yes", "no"), "Dutch": ("ja", "nee"), "Italian": ("sì", "no"), "German": ("ja", "nein"),
    "Montenegrin": ("da", "ne"), "Serbian": ("да", "не"), "Albanian": ("po", "jo"),
}
# ---------------------------------------------------------------------------

N_COUNTRIES = len(COUNTRY_FIXTURE)
COUNTRY_IDS = [c[0] for c in COUNTRY_FIXTURE]


def _first_seen(seq):
    out = []
    for x in seq:
        if x not in out:
            out.append(x)
    return out


LANGUAGE_CODES = _first_seen(code for c in COUNTRY_FIXTURE for _, code in c[3])
PAIR_KEYS = [f"{code}_{c[0]}" for c in COUNTRY_FIXTURE for _, code in c[3]]
SUPPLIERS_PER_GROUP = 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list, idx) -> "F.Column":
    """element ``idx`` (0-based column) of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def n_groups(spark: SparkSession, sf_dir: str) -> int:
    """Groups of the five countries: one per 25 suppliers, one at least."""
    return max(1, read(spark, sf_dir, "supplier").count() // SUPPLIERS_PER_GROUP)


def _of_group(values: list, idx, sep: str = ""):
    """Element ``idx % n`` of the list, marked with its group ``idx div n`` from the second group on."""
    group = F.floor(idx / len(values)).cast("int")
    return F.concat(_pick(values, idx), F.when(group > 0, F.concat(F.lit(sep), group.cast("string"))).otherwise(F.lit("")))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country_id, country, citizenship, languages, language_codes, ord) from ``region``, for every group."""
    fixture = F.array(*[
        F.struct(F.lit(cid).alias("country_id"), F.lit(name).alias("country"), F.lit(cit).alias("citizenship"),
                 F.array(*[F.lit(l) for l, _ in langs]).alias("languages"),
                 F.array(*[F.lit(c) for _, c in langs]).alias("language_codes"))
        for cid, name, cit, langs in COUNTRY_FIXTURE])
    reg = read(spark, sf_dir, "region")
    idx = (F.col("r_regionkey") % N_COUNTRIES).cast("int")
    rows = (reg.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups(spark, sf_dir) - 1))))
            .select((F.col("r_regionkey") + 5 * F.col("g")).cast("int").alias("ord"), F.element_at(fixture, idx + 1).alias("c"),
                    (idx + N_COUNTRIES * F.col("g")).alias("i")))
    return rows.select(_of_group(COUNTRY_IDS, F.col("i")).alias("country_id"),
                       _of_group([c[1] for c in COUNTRY_FIXTURE], F.col("i"), " ").alias("country"),
                       "c.citizenship", "c.languages", "c.language_codes", "ord")


def _of_scenario(line: str, language, country, pair):
    """One of three values by the scenario of a row's line number."""
    scenario = _pick(R.SCENARIOS, F.col(line))
    return F.when(scenario == R.SCENARIO_LANGUAGE, language).when(scenario == R.SCENARIO_COUNTRY, country).otherwise(pair)


def item_scores(spark: SparkSession, sf_dir: str, n_criteria: int = R.TEST_RULES.n_criteria) -> DataFrame:
    """Answer-file rows (scenario, model, unit_key, criterion_id, fact, support, opposition,
    stance and the six response-quality columns) from ``lineitem``: one row per cell,
    the max of (orderkey, linenumber, partkey, suppkey, discount, tax, quantity)."""
    li = read(spark, sf_dir, "lineitem")
    groups = n_groups(spark, sf_dir)
    # Rows are many and sort fast by one number, so the greatest row of each number comes first: all rows of a number are
    # of one cell. Its names are read off that row, and the cells, which are few, are grouped by them.
    parts = [(F.col("l_linenumber") % len(R.SCENARIOS), len(R.SCENARIOS)), (F.col("l_suppkey") % len(TEST_MODELS), len(TEST_MODELS)),
             (_of_scenario("l_linenumber", F.col("l_orderkey") % len(LANGUAGE_CODES), F.col("l_orderkey") % (N_COUNTRIES * groups),
                           F.col("l_orderkey") % (len(PAIR_KEYS) * groups)), max(len(LANGUAGE_CODES), len(PAIR_KEYS) * groups)),
             (F.col("l_partkey") % n_criteria, n_criteria)]
    number = F.lit(0).cast("long")
    for part, n in parts:
        number = number * (2 * n) + F.coalesce(part + n, F.lit(0))  # 0: null
    rows = li.groupBy(number.alias("_number")).agg(
        F.max(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity")).alias("r"))
    keyed = rows.select(
        _pick(R.SCENARIOS, F.col("r.l_linenumber")).alias("scenario"),
        _pick(TEST_MODELS, F.col("r.l_suppkey")).alias("model"),
        _of_scenario("r.l_linenumber", _pick(LANGUAGE_CODES, F.col("r.l_orderkey")),
                     _of_group(COUNTRY_IDS, F.col("r.l_orderkey") % (N_COUNTRIES * groups)),
                     _of_group(PAIR_KEYS, F.col("r.l_orderkey") % (len(PAIR_KEYS) * groups))).alias("unit_key"),
        (F.col("r.l_partkey") % n_criteria).cast("int").alias("criterion_id"),
        "r")
    cell = keyed.groupBy("scenario", "model", "unit_key", "criterion_id").agg(F.max("r").alias("r"))
    fact_raw = np_round(F.col("r.l_discount") * 10, 1)
    fact = F.when(fact_raw < 0.3, F.lit(0.0)).otherwise(fact_raw)
    p = F.col("r.l_discount") * 10
    q = F.col("r.l_quantity") / 50.0
    fval = np_round((F.col("r.l_partkey") % 6) / 5.0, 2)
    sval = np_round((F.col("r.l_suppkey") % 6) / 5.0, 2)
    fcoh = F.when(fval > 0, np_round(1 - 4 * p * (1 - p), 2))
    scoh = F.when(sval > 0, np_round(1 - 4 * q * (1 - q), 2))
    return (cell.select("scenario", "model", "unit_key", "criterion_id",
                        fact.alias("fact"),
                        (F.col("r.l_tax") / 0.08).alias("support"),
                        q.alias("opposition"),
                        fcoh.alias("fact_coherence"), fval.alias("fact_validity"),
                        scoh.alias("stance_coherence"), sval.alias("stance_validity"))
            .withColumn("stance", stance_score_rounded("support", "opposition"))
            .withColumn("fact_weighted", F.coalesce(np_round(F.col("fact_coherence") * F.col("fact_validity"), 2),
                                                    F.lit(0.0)))
            .withColumn("stance_weighted", F.coalesce(np_round(F.col("stance_coherence") * F.col("stance_validity"), 2),
                                                      F.lit(0.0))))


def truth_wide(spark: SparkSession, sf_dir: str, n_criteria: int = R.TEST_RULES.n_criteria) -> DataFrame:
    """Wide truth table (country_id, country, crit_0..crit_{n-1}) from ``orders``:
    country ``o_orderkey % (5 * groups)``, criterion ``o_custkey % n``, status of the max orderkey
    (F -> 1, P -> 0.5, O -> 0)."""
    o = read(spark, sf_dir, "orders")
    cells = (o.select((F.col("o_orderkey") % (N_COUNTRIES * n_groups(spark, sf_dir))).alias("i"),
                      (F.col("o_custkey") % n_criteria).cast("int").alias("criterion_id"),
                      "o_orderkey", "o_orderstatus")
             .groupBy("i", "criterion_id")
             .agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
             .select("i", F.concat(F.lit("crit_"), F.col("criterion_id").cast("string")).alias("crit"),
                     F.when(F.col("status") == "F", 1.0).when(F.col("status") == "P", 0.5)
                     .otherwise(0.0).alias("score")))
    wide = cells.groupBy("i").pivot("crit", [f"crit_{i}" for i in range(n_criteria)]).agg(F.first("score"))
    return wide.select(_of_group(COUNTRY_IDS, F.col("i")).alias("country_id"),
                       _of_group([c[1] for c in COUNTRY_FIXTURE], F.col("i"), " ").alias("country"),
                       *[f"crit_{i}" for i in range(n_criteria)])


def weights(spark: SparkSession, sf_dir: str, n_criteria: int = R.TEST_RULES.n_criteria) -> DataFrame:
    """(criterion_id, weight) from ``part``: mean p_size per ``p_partkey % n``, scaled to sum 100."""
    p = read(spark, sf_dir, "part")
    per = p.groupBy((F.col("p_partkey") % n_criteria).cast("int").alias("criterion_id")).agg(
        F.avg("p_size").alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))
    # snapped to 10 decimals: the sum's order must not show in the last bit
    return per.select("criterion_id", np_round(F.col("w") * 100.0 / total, 10).alias("weight"))


def answer_text(event_type, event_id, yes_tok, no_tok):
    """Raw model response text of one sample event (covers every normalising branch)."""
    et = F.col(event_type)
    k = F.col(event_id) % 4
    yes_txt = (F.when(k == 0, F.concat(F.lit("**"), F.upper(yes_tok), F.lit("**, of course.")))
               .when(k == 1, F.concat(F.lit(" \u00a0"), yes_tok, F.lit("\u202f!")))
               .when(k == 2, F.concat(F.lit('"'), yes_tok, F.lit('."\n'), no_tok))
               .otherwise(F.concat(F.upper(yes_tok), F.lit("."))))
    no_txt = (F.when(k == 0, F.concat(F.upper(no_tok), F.lit(", it does not.")))
              .when(k == 1, F.concat(no_tok, F.lit("\u3000;")))
              .otherwise(F.concat(F.lit("*"), no_tok, F.lit("*"))))
    undef_txt = (F.when(k == 0, F.concat(F.lit("Maybe "), yes_tok))
                 .when(k == 1, F.lit("**"))
                 .when(k == 2, F.lit("I cannot answer that."))
                 .otherwise(F.lit("")))
    return (F.when(et.isin("purchase", "click"), yes_txt)
            .when(et.isin("view", "signup"), no_txt)
            .otherwise(undef_txt))


SAMPLE_UNITS = [(R.SCENARIO_LANGUAGE, "sr", "Serbian"), (R.SCENARIO_COUNTRY, "IT", "English"),
                (R.SCENARIO_LANGUAGE_COUNTRY, "de_IT", "German"), (R.SCENARIO_LANGUAGE, "en", "English"),
                (R.SCENARIO_LANGUAGE_COUNTRY, "sq_XK", "Albanian")]


def samples(spark: SparkSession, sf_dir: str, n_criteria: int = R.TEST_RULES.n_criteria) -> DataFrame:
    """Raw sample responses (scenario, model, unit_key, prompt_language, criterion_id,
    question_type, sample_order, response) from ``events``: model ``user_id % 4``,
    unit ``(user_id div 5) % 5``, criterion ``event_id % n``, type ``(event_id div n) % 3``,
    order ``event_id``; the response text follows the event type."""
    ev = read(spark, sf_dir, "events")
    unit_idx = (F.floor(F.col("user_id") / 5) % len(SAMPLE_UNITS)).cast("int") + 1
    units = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.lit(l).alias("l"))
                      for s, k, l in SAMPLE_UNITS])
    yes_map = F.create_map(*[x for lang, (y, _) in PROMPT_TOKENS.items() for x in (F.lit(lang), F.lit(y))])
    no_map = F.create_map(*[x for lang, (_, n) in PROMPT_TOKENS.items() for x in (F.lit(lang), F.lit(n))])
    base = ev.select("event_id", "event_type", F.element_at(units, unit_idx).alias("u"),
                     _pick(TEST_MODELS[:4], F.col("user_id")).alias("model"))
    # tokens as their own columns first (not re-derived inside every text branch)
    toks = base.select("*", F.element_at(yes_map, F.col("u.l")).alias("_yes"),
                       F.element_at(no_map, F.col("u.l")).alias("_no"))
    return toks.select(
        F.col("u.s").alias("scenario"), "model", F.col("u.k").alias("unit_key"), F.col("u.l").alias("prompt_language"),
        (F.col("event_id") % n_criteria).cast("int").alias("criterion_id"),
        _pick(R.QUESTION_TYPES, F.floor(F.col("event_id") / n_criteria)).alias("question_type"),
        F.col("event_id").alias("sample_order"),
        answer_text("event_type", "event_id", F.col("_yes"), F.col("_no")).alias("response"))


# ---------------------------------------------------------------------------
# Text inputs
# ---------------------------------------------------------------------------
LANGUAGE_ORDER = _first_seen(l for c in COUNTRY_FIXTURE for l, _ in c[3])
# quote styles a translated instruction may use: (open, close)
QUOTE_STYLES = [('"', '"'), ("«", "»"), ("“", "”")]


def translated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate translated answer instructions (language, conv_id, turn, prompt)
    from every assistant turn of ``conversations``: language ``conv_id % L``; the
    instruction quotes the language's yes / no tokens, followed by the turn text."""
    conv = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    langs = [l for l in LANGUAGE_ORDER if l != R.ENGLISH]
    lang = _pick(langs, F.col("conv_id"))
    style = (F.col("conv_id") % len(QUOTE_STYLES)).cast("int") + 1
    opens = F.array(*[F.lit(o) for o, _ in QUOTE_STYLES])
    closes = F.array(*[F.lit(c) for _, c in QUOTE_STYLES])
    yes_map = F.create_map(*[x for l, (y, _) in PROMPT_TOKENS.items() for x in (F.lit(l), F.lit(y))])
    no_map = F.create_map(*[x for l, (_, n) in PROMPT_TOKENS.items() for x in (F.lit(l), F.lit(n))])
    o, c = F.element_at(opens, style), F.element_at(closes, style)
    prompt = F.concat(F.lit("Answer with "), o, F.element_at(yes_map, lang), c, F.lit(" or "), o,
                      F.element_at(no_map, lang), c, F.lit(" only. "), F.col("text"))
    return conv.select(lang.alias("language"), "conv_id", "turn", prompt.alias("prompt"))


def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies around a translation (doc_id, reply) from ``documents``: the
    whole text wrapped in one of eight reply shapes chosen by ``doc_id % 8``."""
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 8
    t = F.col("text")
    reply = (F.when(k == 0, F.concat(F.lit("Translation: "), t, F.lit("\nNote: this is a comment")))
             .when(k == 1, F.concat(F.lit("**"), t, F.lit("**")))
             .when(k == 2, F.concat(F.lit("\u2028\u00a0"), t, F.lit("\u3000")))
             .when(k == 3, F.concat(F.lit("Here is the explanation\n"), t))
             .when(k == 4, F.lit(""))
             .when(k == 5, F.concat(F.lit("Note: "), t))
             .when(k == 6, F.concat(t, F.lit(" Note:x tail")))
             .otherwise(F.concat(F.lit("_"), t, F.lit("_\ncomment: short"))))
    return d.select("doc_id", reply.alias("reply"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw generations (conv_id, turn, output) from ``conversations``: the turn text
    with chat-template markers chosen by ``(conv_id + turn) % 4``."""
    c = read(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    t = F.col("text")
    out = (F.when(k == 0, F.concat(F.lit("system<|CHATBOT_TOKEN|>"), t, F.lit("<|im_end|><|endoftext|>")))
           .when(k == 1, F.concat(F.lit("\u202f"), t, F.lit("\u00a0<|x|>")))
           .when(k == 2, F.concat(F.lit("a<|CHATBOT_TOKEN|>b<|CHATBOT_TOKEN|> "), t,
                                  F.lit(" <|im_end|>\n<|endoftext|>")))
           .otherwise(t))
    return c.select("conv_id", "turn", out.alias("output"))


def quoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts carrying quoted tokens (doc_id, text) from ``documents``: the first two
    words quoted in style ``doc_id % 6`` (5 = no quotes) before the whole text."""
    d = read(spark, sf_dir, "documents")
    styles = [('"', '"'), ("«", "»"), ("“", "”"), ("‘", "’"), ("'", "'")]
    k = (F.col("doc_id") % 6).cast("int")
    words = F.split(F.col("text"), " ")
    w1, w2 = F.element_at(words, 1), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("x"))
    opens = F.array(*[F.lit(o) for o, _ in styles])
    closes = F.array(*[F.lit(c) for _, c in styles])
    o, c = F.element_at(opens, k + 1), F.element_at(closes, k + 1)
    quoted = F.concat(F.lit("Reply "), o, w1, c, F.lit(" or "), o, F.lit("\u00a0"), w2, F.lit("\u2028"), c, F.lit(": "),
                      F.col("text"))
    return d.select("doc_id", F.when(k == 5, F.col("text")).otherwise(quoted).alias("text"))


def base_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English questionnaire items (criterion_id, question_type, text) from
    ``benchmark``: criterion ``item_id div 3``, type ``item_id % 3``."""
    b = read(spark, sf_dir, "benchmark")
    return b.select((F.floor(F.col("item_id") / 3)).cast("int").alias("criterion_id"),
                    _pick(R.QUESTION_TYPES, F.col("item_id")).alias("question_type"),
                    F.col("text"))


# ---------------------------------------------------------------------------
# Translation-quality inputs
# ---------------------------------------------------------------------------
TRANSLATION_SYSTEMS = ["DeepL", "Qwen/Qwen3.5-9B", "Qwen/Qwen3.5-27B", "gpt-5.4"]


def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded original / back-translated sentence pairs from ``embeddings``:
    an even ``vec_id`` is the original, ``vec_id + 1`` its back-translation;
    system ``(vec_id div 2) % 4``, language ``label % 7``, question ``vec_id div 2``."""
    e = read(spark, sf_dir, "embeddings")
    orig = e.where(F.col("vec_id") % 2 == 0).select(
        "vec_id", F.col("embedding").alias("original"), "label")
    back = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("back"))
    codes = dict((l, c) for cc in COUNTRY_FIXTURE for l, c in cc[3])
    lang = _pick(LANGUAGE_ORDER, F.col("label"))
    code_map = F.create_map(*[x for l in LANGUAGE_ORDER for x in (F.lit(l), F.lit(codes[l]))])
    return orig.join(back, "vec_id", "left").select(
        _pick(TRANSLATION_SYSTEMS, F.floor(F.col("vec_id") / 2)).alias("model"),
        lang.alias("language"), F.element_at(code_map, lang).alias("language_code"),
        F.floor(F.col("vec_id") / 2).alias("question_id"), "original", "back")


# ---------------------------------------------------------------------------
# Knowledge-graph triples
# ---------------------------------------------------------------------------
# nation key % 25 -> country label as the graph spells it
GRAPH_COUNTRY_LABELS = [
    "Albania", "Andorra", "Armenia", "Austria", "Azerbaijan", "Belgium", "Bosnia and Herzegovina", "Bulgaria",
    "Croatia", "Cyprus", "Czech Republic", "Denmark", "Estonia", "Finland", "France", "Georgia", "Germany",
    "Greece", "Kingdom of the Netherlands", "country of the Kingdom of the Netherlands", "Norway", "Switzerland",
    "Ukraine", "United Kingdom", "Italy",
]
# language entity k -> (label, code or None)
GRAPH_LANGUAGES = [
    ("Albanian", "sq"), ("Catalan", "ca"), ("Armenian", "hy"), ("German", "de"), ("French", "fr"),
    ("Modern Greek", "el"), ("Norwegian", "no"), ("Romansh", "rm"), ("Dutch", "nl"), ("English", None),
]


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object, lang, ordinal) facts about countries and languages from
    ``nation``, numbered as they are first stated: labels, official languages (P37), language codes (P424), ISO codes
    (P297, missing for key % 7 = 6), demonyms (P1549; English one missing for key % 5 = 4)."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    subj = F.concat(F.lit("Q"), F.col("k").cast("string"))
    name = _pick(GRAPH_COUNTRY_LABELS, F.col("k"))
    lang1 = F.col("k") % len(GRAPH_LANGUAGES)
    lang2 = (F.col("k") + 4) % len(GRAPH_LANGUAGES)
    lname = F.array(*[F.lit(l) for l, _ in GRAPH_LANGUAGES])
    lcode = F.array(*[F.lit(c) for _, c in GRAPH_LANGUAGES])

    def t(s, p, o, lang=None):
        return F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"),
                        (F.lit(lang) if lang else F.lit(None).cast("string")).alias("lang"))

    def lent(idx):
        return F.concat(F.lit("L"), idx.cast("string"))

    facts = F.array(
        t(subj, "label", name, "en"),
        t(subj, "P37", lent(lang1)),
        t(subj, "P37", F.when(F.col("k") % 3 == 0, lent(lang2))),
        t(subj, "P297", F.when(F.col("k") % 7 != 6, F.upper(F.substring(name, 1, 2)))),
        t(subj, "P1549", F.when(F.col("k") % 5 != 4, F.concat(name, F.lit("ian"))), "en"),
        t(subj, "P1549", F.concat(F.lit("les "), name), "fr"),
        t(lent(lang1), "label", F.element_at(lname, lang1.cast("int") + 1), "en"),
        t(lent(lang1), "P424", F.element_at(lcode, lang1.cast("int") + 1)),
        t(lent(lang2), "label", F.element_at(lname, lang2.cast("int") + 1), "en"),
        t(lent(lang2), "P424", F.element_at(lcode, lang2.cast("int") + 1)),
    )
    return (n.select("k", F.posexplode(facts).alias("place", "f")).select("f.*", (F.col("k") * 10 + F.col("place")).alias("ordinal"))
            .where(F.col("object").isNotNull()).groupBy("subject", "predicate", "object", "lang").agg(F.min("ordinal").alias("ordinal")))


def graph_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject list of the graph query (with repeats): one per ``supplier`` row."""
    s = read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("Q"), F.col("s_nationkey").cast("string")).alias("subject"))
