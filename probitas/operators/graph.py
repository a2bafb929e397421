"""Graph-pattern extraction of country / language reference data over a triples
table (re-aimed from a remote SPARQL endpoint), name normalising, and the ordered
per-country language lists built from the bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from probitas import rules as R
from probitas.session import materialize
from probitas.sources import store as ST

BINDING_COLS = ["country", "country_label", "language", "language_label", "language_code", "citizenship",
                "country_code"]


def _pred(triples: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return triples.where(F.col("predicate") == p).select(F.col("subject").alias(s), F.col("object").alias(o))


def with_ordinal(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """``df`` with the place (from 0, without gaps) of every row in ``order``.

    A range sort deals the rows out in order; a row's place is its place in its partition plus the rows of the partitions
    before, which are counts of one row per partition. The sorted rows are a written table, so that places stay what they are.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    firsts = (rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    place = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.withColumn("_part", part).join(F.broadcast(firsts), "_part")
            .select(*[F.col(f"`{c}`") for c in df.columns if c != name], place.alias(name)))


def country_bindings(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Bindings of the country query (G1-G6):

    * subjects: distinct list, semi-joined (repeats in the list do not multiply rows);
    * OPTIONAL {official language . its code}: the two patterns join first, then left join;
    * OPTIONAL ISO code; OPTIONAL English demonym (filter applied before the left join);
    * labels with fallback to the id.

    ``triples`` is scanned once per pattern, so it should be a stored table. If it numbers its statements
    (``ordinal``), a binding carries the number of its official-language statement.
    """
    number = ["ordinal"] if "ordinal" in triples.columns else []
    labels = triples.where(F.col("predicate") == "label").select(F.col("subject").alias("_id"),
                                                                F.col("object").alias("_label"))
    base = (subjects.select(F.col("subject").alias("country")).distinct()
            .join(labels.withColumnRenamed("_id", "country"), "country", "left")
            .select("country", F.coalesce("_label", "country").alias("country_label")))
    langs = (triples.where(F.col("predicate") == "P37").select(F.col("subject").alias("country"), F.col("object").alias("language"), *number)
             .join(_pred(triples, "P424", "language", "language_code"), "language", "inner")
             .join(labels.withColumnRenamed("_id", "language"), "language", "left")
             .select("country", "language", F.coalesce("_label", "language").alias("language_label"),
                     "language_code", *number))
    iso = _pred(triples, "P297", "country", "country_code")
    dem = (triples.where((F.col("predicate") == "P1549") & (F.col("lang") == "en"))
           .select(F.col("subject").alias("country"), F.col("object").alias("citizenship")))
    return (base.join(langs, "country", "left").join(iso, "country", "left").join(dem, "country", "left")
            .select(*BINDING_COLS, *number))


def normalize_names(bindings: DataFrame) -> DataFrame:
    """Country renames / drops, demonym override, dropped languages and language
    renames of the reference data (T8). Rule lists are fixed values."""
    rename = F.create_map(*[x for k, v in R.COUNTRY_RENAMES.items() for x in (F.lit(k), F.lit(v))])
    lrename = F.create_map(*[x for k, v in R.LANGUAGE_RENAMES.items() for x in (F.lit(k), F.lit(v))])
    demonym = F.create_map(*[x for k, v in R.DEMONYM_OVERRIDES.items() for x in (F.lit(k), F.lit(v))])
    country = F.coalesce(F.element_at(rename, F.col("country_label")), F.col("country_label"))
    out = (bindings.where(~F.col("country_label").isin(*R.DROPPED_COUNTRIES))
           .withColumn("country_name", country)
           .withColumn("citizenship", F.coalesce(F.element_at(demonym, F.col("country_name")), F.col("citizenship")))
           .where(~F.coalesce(F.col("language_label"), F.lit("")).isin(*R.DROPPED_LANGUAGES))
           .withColumn("language_name", F.coalesce(F.element_at(lrename, F.col("language_label")),
                                                   F.col("language_label"))))
    number = ["ordinal"] if "ordinal" in bindings.columns else []
    return out.select("country", "country_name", "citizenship", "language_name", "language_code", "country_code", *number)


def complete_bindings(normalized: DataFrame, skipped: Observation | None = None) -> DataFrame:
    """Rows with every field present; the others are skipped. ``skipped`` observes ``bindings`` and
    ``bindings_skipped`` in the pass that reads the result."""
    need = ["country_name", "citizenship", "language_name", "language_code", "country_code"]
    cond = F.lit(True)
    for c in need:
        cond = cond & F.col(c).isNotNull()
    if skipped is not None:
        normalized = normalized.observe(skipped, F.count(F.lit(1)).alias("bindings"),
                                        F.coalesce(F.sum((~cond).cast("long")), F.lit(0)).alias("bindings_skipped"))
    return normalized.where(cond)


def collect_country_languages(rows: DataFrame) -> DataFrame:
    """Per country: the country code and citizenship seen first, and the languages and codes in first-seen order.

    Rows are seen in the order of their ``ordinal`` (:func:`with_ordinal`), without one by (language, code, citizenship,
    country code). A pair is left out where its name and its code are both there already, be it in different pairs. Repeats are
    combined first, so a country's list is bounded by its language vocabulary.
    """
    keys = ["ordinal"] if "ordinal" in rows.columns else []
    order = F.struct(*keys, "language_name", "language_code", "citizenship", "country_code")
    pairs = (rows.groupBy("country_name", "language_name", "language_code")
             .agg(F.min(order).alias("o")))
    per = pairs.groupBy("country_name").agg(
        F.array_sort(F.collect_list(F.struct("o", "language_name", "language_code"))).alias("seen"),
        F.min("o").alias("first"))

    def add(kept: Column, new: Column) -> Column:
        known = (F.exists(kept, lambda x: x["language_name"] == new["language_name"])
                 & F.exists(kept, lambda x: x["language_code"] == new["language_code"]))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(new)))

    per = per.withColumn("l", F.aggregate("seen", F.slice("seen", 1, 0), add))
    return per.select(
        F.col("country_name").alias("country"),
        F.col("first.country_code").alias("country_id"),
        F.col("first.citizenship").alias("citizenship"),
        F.concat_ws("|", F.transform("l", lambda x: x["language_name"])).alias("languages"),
        F.concat_ws("|", F.transform("l", lambda x: x["language_code"])).alias("language_codes"),
        F.size("l").alias("n_languages"))


def language_counts(normalized: DataFrame) -> DataFrame:
    """Language rows, distinct language codes and distinct countries of the
    complete bindings, and the number of bindings skipped for a missing field (A22)."""
    need = ["country_name", "citizenship", "language_name", "language_code", "country_code"]
    complete = F.lit(True)
    for c in need:
        complete = complete & F.col(c).isNotNull()
    return normalized.agg(
        F.count(F.when(complete, F.lit(1))).alias("n_language_rows"),
        F.count_distinct(F.when(complete, F.col("language_code"))).alias("n_codes"),
        F.count_distinct(F.when(complete, F.col("country_name"))).alias("n_countries"),
        F.count(F.when(~complete, F.lit(1))).alias("n_skipped_rows"))


SKETCH_BITS = 14  # a sketch has 2 ** 14 registers: a relative standard error of 1.04 / 2 ** 7, and exact while it still lists its values


def count_sketches(normalized: DataFrame, run: str) -> DataFrame:
    """The counts of :func:`language_counts` in a form that can be merged: one row of ``run`` with sums and HyperLogLog sketches."""
    need = ["country_name", "citizenship", "language_name", "language_code", "country_code"]
    complete = F.lit(True)
    for c in need:
        complete = complete & F.col(c).isNotNull()
    return normalized.agg(
        F.lit(run).alias("source"), F.count(F.when(complete, F.lit(1))).alias("n_language_rows"), F.count(F.when(~complete, F.lit(1))).alias("n_skipped_rows"),
        F.hll_sketch_agg(F.when(complete, F.col("language_code")), SKETCH_BITS).alias("codes"),
        F.hll_sketch_agg(F.when(complete, F.col("country_name")), SKETCH_BITS).alias("countries"))


def store_counts(normalized: DataFrame, run: str, root: str) -> None:
    """Add the counts of one run to the stored table ``root``; a run that is repeated replaces its own row."""
    ST.upsert(count_sketches(normalized, run), root, ["source"], ["source"])


def merged_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts over all stored runs, without reading their bindings again.

    Rows are summed; codes and countries that several runs have seen count once, with the sketch's error. Runs without
    any complete binding add nothing.
    """
    size = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}")
    return ST.read_store(spark, root).agg(F.sum("n_language_rows").alias("n_language_rows"), size("codes"), size("countries"),
                                          F.sum("n_skipped_rows").alias("n_skipped_rows"))
