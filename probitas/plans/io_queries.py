"""Registered source / sink round trips and small operators (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas import rules as R
from probitas.functions.numeric import np_round, to_double
from probitas.operators import samples as SM
from probitas.operators import translation as TR
from probitas.operators.compare import COMPARISON_COLUMNS
from probitas.operators.units import UNIT
from probitas.plans import sql_inputs as S
from probitas.plans import sql_text as ST
from probitas.plans.inputs import Inputs, staged_comparison
from probitas.plans.registry import register
from probitas.session import materialize, stage_path
from probitas.sources import driver_tables as D
from probitas.sources import io as IO
from probitas.sources import store as STORE

ITEM_COLS = ["scenario", "model", "unit_key"] + IO.ANSWER_COLUMNS
ITEM_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("scenario", "model", "unit_key")]
    + [T.StructField("criterion_id", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in IO.ANSWER_COLUMNS[1:]])
ITEMS_SQL = S.with_inputs(f"SELECT {', '.join(ITEM_COLS)} FROM item_scores", S.cte_item_scores())


@register("scan_delimited", ITEMS_SQL)
def scan_delimited(spark, sf_dir):
    """Answer rows written as a ';'-delimited file with header and read back with an explicit schema."""
    path = stage_path(spark, "delimited")
    IO.write_delimited(Inputs.of(spark, sf_dir).item_scores.select(*ITEM_COLS), path)
    return IO.read_delimited(spark, path, ITEM_SCHEMA).select(*ITEM_COLS)


@register("scan_answer_store", ITEMS_SQL)
def scan_answer_store(spark, sf_dir):
    """Answer rows through the (scenario, model)-partitioned store: partition columns from the layout."""
    root = stage_path(spark, "answer_store")
    IO.write_answer_store(Inputs.of(spark, sf_dir).item_scores.select(*ITEM_COLS), root)
    return IO.scan_answer_store(spark, root).select(*ITEM_COLS)


@register("append_answer_store", ITEMS_SQL)
def append_answer_store(spark, sf_dir):
    """The answer store grown by three appends of different units."""
    root = stage_path(spark, "answer_store")
    items = Inputs.of(spark, sf_dir).item_scores.select(*ITEM_COLS)
    part = F.pmod(F.xxhash64("unit_key"), F.lit(3))
    for k in range(3):
        IO.append_answer_store(items.where(part == k), root)
    return IO.scan_answer_store(spark, root).select(*ITEM_COLS)


_OPEN_SQL = S.with_inputs(
    f"SELECT {', '.join(ITEM_COLS)} FROM item_scores JOIN (SELECT scenario, model, unit_key FROM item_scores "
    f"WHERE scenario <> {S.q(R.SCENARIO_LANGUAGE)} GROUP BY ALL HAVING count(*) <> {R.TEST_RULES.n_criteria}) USING (scenario, model, unit_key)",
    S.cte_item_scores())


def _open_units(items):
    """Units of two scenarios whose rows are not complete, a set known only when the query runs."""
    counts = items.where(F.col("scenario") != R.SCENARIO_LANGUAGE).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") != R.TEST_RULES.n_criteria)


@register("lookup_answer_store", _OPEN_SQL)
def lookup_answer_store(spark, sf_dir):
    """Rows of the open units from the partitioned answer store; partitions are pruned when the scan runs (S3)."""
    root = stage_path(spark, "answer_store")
    items = Inputs.of(spark, sf_dir).item_scores.select(*ITEM_COLS)
    IO.write_answer_store(items, root)
    return IO.scan_answer_store(spark, root, units=_open_units(items)).select(*ITEM_COLS)


@register("lookup_versioned_store", _OPEN_SQL)
def lookup_versioned_store(spark, sf_dir):
    """The same from a store that is upserted, whose version lists its partitions (S3, U4)."""
    root = stage_path(spark, "answers")
    items = Inputs.of(spark, sf_dir).item_scores.select(*ITEM_COLS)
    STORE.append(items, root, ["scenario", "model"])
    return IO.scan_answer_store(spark, root, units=_open_units(items)).select(*ITEM_COLS)


_JSON_SQL = S.with_inputs(
    "SELECT country, country_id, citizenship, array_to_string(languages, '|') AS languages, "
    "array_to_string(language_codes, '|') AS language_codes, ord FROM countries", S.cte_countries())


@register("scan_json_map", _JSON_SQL)
def scan_json_map(spark, sf_dir):
    """Country records as one JSON map document, read back and exploded."""
    path = stage_path(spark, "countries_json")
    countries = Inputs.of(spark, sf_dir).countries
    IO.write_json_map(countries, "country", path)
    schema = T.StructType([T.StructField("country_id", T.StringType()), T.StructField("citizenship", T.StringType()),
                           T.StructField("languages", T.ArrayType(T.StringType())),
                           T.StructField("language_codes", T.ArrayType(T.StringType())),
                           T.StructField("ord", T.IntegerType())])
    rows = IO.scan_json_map(spark, path, schema, key="country")
    return rows.select("country", "country_id", "citizenship", F.concat_ws("|", "languages").alias("languages"),
                       F.concat_ws("|", "language_codes").alias("language_codes"), "ord")


@register("sink_roundtrip", S.with_inputs("SELECT * FROM comparison", *S.comparison_inputs()))
def sink_roundtrip(spark, sf_dir):
    """Staged comparison table through a ';'-delimited sink and back."""
    comp = staged_comparison(spark, sf_dir)
    path = stage_path(spark, "comparison_csv")
    IO.write_delimited(comp, path)
    return IO.read_delimited(spark, path, comp.schema).select(*COMPARISON_COLUMNS)


_RAW = "CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'signup' THEN 'NaN' ELSE CAST(value AS VARCHAR) END"


@register("numeric_coerce", S.with_inputs(
    f"SELECT event_id, raw, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS value "
    f"FROM (SELECT event_id, {_RAW} AS raw FROM events)"))
def numeric_coerce(spark, sf_dir):
    """Text cells to numbers; anything not numeric (and NaN) becomes NULL."""
    ev = D.read(spark, sf_dir, "events")
    raw = (F.when(F.col("event_type") == "error", F.lit("n/a")).when(F.col("event_type") == "signup", F.lit("NaN"))
           .otherwise(F.col("value").cast("string")))
    return ev.select("event_id", raw.alias("raw")).select("event_id", "raw", to_double("raw").alias("value"))


@register("round_half_even", S.with_inputs(
    f"SELECT event_id, value, {S.npr('value / 3.0', 2)} AS third_2dp, {S.npr('value * 10.0', 0)} AS tenfold_int "
    "FROM events"))
def round_half_even(spark, sf_dir):
    """Rounding half to even on the binary value (array-library rule), 2 dp and integers."""
    ev = D.read(spark, sf_dir, "events")
    return ev.select("event_id", "value", np_round(F.col("value") / 3.0, 2).alias("third_2dp"),
                     np_round(F.col("value") * 10.0, 0).alias("tenfold_int"))


SAMPLE_SEED = 42
_HASH_SQL = f"((CAST(criterion_id AS BIGINT) * 2654435761 + {SAMPLE_SEED} * 97) % 4294967296)"


@register("stratified_sample", S.with_inputs(
    f"SELECT question_type, criterion_id, text, {_HASH_SQL} AS draw FROM base_q "
    f"QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY {_HASH_SQL}, criterion_id) <= 3",
    ST.cte_base_questions()))
def stratified_sample(spark, sf_dir):
    """3 items per question type, drawn once by a seeded hash order (O6). Each type
    holds a third of the items: the top-k keeps only 3 rows per type and map task
    before the shuffle."""
    items = D.base_questions(spark, sf_dir)
    draw = (F.col("criterion_id").cast("bigint") * F.lit(2654435761) + F.lit(SAMPLE_SEED * 97)) % F.lit(4294967296)
    items = items.withColumn("draw", draw)
    top = SM.top_k_per_group(items, ["question_type"], [F.col("draw"), F.col("criterion_id")], 3)
    return top.select("question_type", "criterion_id", "text", "draw")


def _bt_half(spark, sf_dir, first: bool):
    """Scores of one half of the questions, as a stored table."""
    pairs = D.translation_pairs(spark, sf_dir)
    mid = D.read(spark, sf_dir, "embeddings").agg(F.floor(F.max("vec_id") / 4)).scalar()
    part = pairs.where(F.col("question_id") < mid) if first else pairs.where(F.col("question_id") >= mid)
    return materialize(TR.backtranslation_score(TR.pair_similarity(part)).select("model", "language", "score"), "bt-half")


_MID = "(SELECT floor(max(vec_id) / 4) FROM embeddings)"


def _halves_sql(body: str) -> str:
    from probitas.plans.text_queries import _bt_cte, _trans_ctes
    return S.with_inputs(body, *_trans_ctes(), _bt_cte("bt1", f"WHERE question_id < {_MID}"),
                         _bt_cte("bt2", f"WHERE question_id >= {_MID}"))


@register("append_missing_rows", _halves_sql(
    "SELECT model, language, score FROM bt1 UNION ALL "
    "SELECT model, language, score FROM bt2 ANTI JOIN bt1 USING (model, language)"))
def append_missing_rows(spark, sf_dir):
    """Scores of the first question half, plus the second-half rows whose
    (system, language) key is still absent (U2)."""
    return TR.append_missing(_bt_half(spark, sf_dir, True), _bt_half(spark, sf_dir, False), ["model", "language"])


@register("upsert_rows", _halves_sql(
    "SELECT model, language, score FROM bt1 ANTI JOIN bt2 USING (model, language) UNION ALL "
    "SELECT model, language, score FROM bt2"))
def upsert_rows(spark, sf_dir):
    """Scores of the first question half with every (system, language) key that the
    second half scored replaced by its new value (U4)."""
    return TR.upsert(_bt_half(spark, sf_dir, True), _bt_half(spark, sf_dir, False), ["model", "language"])


@register("stored_upsert", _halves_sql(
    "SELECT model, language, score FROM bt1 WHERE model = 'gpt-5.4' UNION ALL "
    "SELECT model, language, score FROM bt2 ANTI JOIN (SELECT * FROM bt1 WHERE model = 'gpt-5.4') USING (model, language) UNION ALL "
    "SELECT model, language, score FROM bt1 ANTI JOIN bt2 USING (model, language) WHERE model <> 'gpt-5.4'"))
def stored_upsert(spark, sf_dir):
    """A stored score table made of the first question half, upserted with the second and then, for one system, with the
    first again: touched partitions are written anew, each time by one switch (U2, U4)."""
    root, keys = stage_path(spark, "scores"), ["model", "language"]
    first = _bt_half(spark, sf_dir, True)
    STORE.upsert(first, root, keys, ["model"])
    STORE.upsert(_bt_half(spark, sf_dir, False), root, keys, ["model"])
    STORE.upsert(first.where("model = 'gpt-5.4'"), root, keys, ["model"])
    STORE.upsert(first, root, keys, ["model"], insert_only=True)  # all there already
    return STORE.read_store(spark, root).select("model", "language", "score")
