"""Registered graph-pattern queries over the triples table (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probitas import rules as R
from probitas.operators import graph as G
from probitas.plans import sql_inputs as S
from probitas.plans.inputs import Inputs
from probitas.plans.registry import register
from probitas.session import stage_path
from probitas.sources import driver_tables as D
from probitas.sources.ntriples import scan_ntriples, write_ntriples


def _case_map(col: str, mapping: dict) -> str:
    if not mapping:
        return col
    return "CASE " + " ".join(f"WHEN {col} = {S.q(k)} THEN {S.q(v)}" for k, v in mapping.items()) + f" ELSE {col} END"


def _triples_cte() -> str:
    nl = len(D.GRAPH_LANGUAGES)
    lname = S.lst([l for l, _ in D.GRAPH_LANGUAGES])
    lcode = "[" + ", ".join(S.q(c) if c else "NULL" for _, c in D.GRAPH_LANGUAGES) + "]"

    def lent(e):
        return f"'L' || CAST({e} AS VARCHAR)"
    l1, l2 = f"(k % {nl})", f"((k + 4) % {nl})"
    parts = [
        "SELECT subj AS subject, 'label' AS predicate, name AS object, 'en' AS lang FROM nat",
        f"SELECT subj, 'P37', {lent(l1)}, NULL FROM nat",
        f"SELECT subj, 'P37', CASE WHEN k % 3 = 0 THEN {lent(l2)} END, NULL FROM nat",
        "SELECT subj, 'P297', CASE WHEN k % 7 <> 6 THEN upper(substring(name, 1, 2)) END, NULL FROM nat",
        "SELECT subj, 'P1549', CASE WHEN k % 5 <> 4 THEN name || 'ian' END, 'en' FROM nat",
        "SELECT subj, 'P1549', 'les ' || name, 'fr' FROM nat",
    ] + [p for l in (l1, l2) for p in (
        f"SELECT {lent(l)}, 'label', {lname}[CAST({l} AS INTEGER) + 1], 'en' FROM nat",
        f"SELECT {lent(l)}, 'P424', {lcode}[CAST({l} AS INTEGER) + 1], NULL FROM nat")]
    parts = [p.replace(" FROM nat", f", k * 10 + {j}{' AS ordinal' * (j == 0)} FROM nat") for j, p in enumerate(parts)]
    return f"""nat AS (
  SELECT CAST(n_nationkey AS BIGINT) AS k, 'Q' || CAST(n_nationkey AS VARCHAR) AS subj,
         {S.pick(D.GRAPH_COUNTRY_LABELS, 'n_nationkey')} AS name FROM nation),
triples AS (SELECT subject, predicate, object, lang, min(ordinal) AS ordinal FROM ({' UNION ALL '.join(parts)})
            WHERE object IS NOT NULL GROUP BY subject, predicate, object, lang),
glabels AS (SELECT subject AS _id, object AS _label FROM triples WHERE predicate = 'label'),
gbase AS (SELECT s.country, coalesce(l._label, s.country) AS country_label
          FROM (SELECT DISTINCT 'Q' || CAST(s_nationkey AS VARCHAR) AS country FROM supplier) s
          LEFT JOIN glabels l ON l._id = s.country),
glangs AS (SELECT a.subject AS country, a.object AS language, coalesce(l._label, a.object) AS language_label,
                  b.object AS language_code, a.ordinal
           FROM triples a JOIN triples b ON b.subject = a.object AND b.predicate = 'P424'
           LEFT JOIN glabels l ON l._id = a.object WHERE a.predicate = 'P37'),
giso AS (SELECT subject AS country, object AS country_code FROM triples WHERE predicate = 'P297'),
gdem AS (SELECT subject AS country, object AS citizenship FROM triples WHERE predicate = 'P1549' AND lang = 'en'),
bindings AS (
  SELECT b.country, b.country_label, g.language, g.language_label, g.language_code, d.citizenship, i.country_code, g.ordinal
  FROM gbase b LEFT JOIN glangs g USING (country) LEFT JOIN giso i USING (country) LEFT JOIN gdem d USING (country)),
gnorm0 AS (
  SELECT *, {_case_map('country_label', R.COUNTRY_RENAMES)} AS country_name FROM bindings
  WHERE country_label NOT IN ({', '.join(S.q(c) for c in R.DROPPED_COUNTRIES)})),
gnorm AS (
  SELECT country, country_name, {_case_map('country_name', {k: v for k, v in R.DEMONYM_OVERRIDES.items()})
         .replace('ELSE country_name END', 'ELSE citizenship END')} AS citizenship,
         {_case_map('language_label', R.LANGUAGE_RENAMES)} AS language_name, language_code, country_code, country_label, ordinal
  FROM gnorm0 WHERE coalesce(language_label, '') NOT IN ({', '.join(S.q(c) for c in R.DROPPED_LANGUAGES)})),
gcomplete AS (
  SELECT * FROM gnorm WHERE country_name IS NOT NULL AND citizenship IS NOT NULL AND language_name IS NOT NULL
    AND language_code IS NOT NULL AND country_code IS NOT NULL)"""


def _bindings(spark, sf_dir):
    return G.country_bindings(Inputs.of(spark, sf_dir).triples, D.graph_subjects(spark, sf_dir))


@register("triples_to_countries", S.with_inputs(f"SELECT {', '.join(G.BINDING_COLS)} FROM bindings", _triples_cte()))
def triples_to_countries(spark, sf_dir):
    """Country bindings of the graph pattern: subject list, paired optional language
    and code, optional ISO code and English demonym, labels with fallback (G1-G6)."""
    return _bindings(spark, sf_dir).drop("ordinal")


@register("triples_from_file", S.with_inputs(f"SELECT {', '.join(G.BINDING_COLS)} FROM bindings", _triples_cte()))
def triples_from_file(spark, sf_dir):
    """The country bindings (G1-G6) from a triples table that is written as N-Triples files and read back."""
    path, base = stage_path(spark, "ntriples"), "http://example.org/"
    write_ntriples(Inputs.of(spark, sf_dir).triples, F.col("predicate") == "P37", path, base)
    triples, _ = scan_ntriples(spark, path, base)
    return G.country_bindings(triples, D.graph_subjects(spark, sf_dir))


@register("normalize_names", S.with_inputs("SELECT country, country_name, citizenship, language_name, language_code, country_code FROM gnorm", _triples_cte()))
def normalize_names(spark, sf_dir):
    """Country / language name rules applied to the bindings."""
    return G.normalize_names(_bindings(spark, sf_dir)).drop("ordinal")


# Pairs in the order of the bindings (by label, then as stated); one is left out where its name and code are there already.
_COLLECT_SQL = S.with_inputs("""
SELECT country_name AS country, first.country_code AS country_id, first.citizenship AS citizenship,
       array_to_string(list_transform(kept, lambda x: x.n), '|') AS languages, array_to_string(list_transform(kept, lambda x: x.c), '|') AS language_codes,
       CAST(len(kept) AS INTEGER) AS n_languages
FROM (SELECT country_name, min(o) AS first, list_reduce(list([struct_pack(n := language_name, c := language_code)] ORDER BY o), lambda kept, x:
        CASE WHEN len(list_filter(kept, lambda k: k.n = x[1].n)) > 0 AND len(list_filter(kept, lambda k: k.c = x[1].c)) > 0
             THEN kept ELSE list_concat(kept, x) END) AS kept
      FROM (SELECT *, struct_pack(a := country_label, b := ordinal, c := country, language_code := language_code, citizenship := citizenship,
                                  country_code := country_code) AS o FROM gcomplete)
      GROUP BY country_name)""", _triples_cte())


@register("collect_country_languages", _COLLECT_SQL)
def collect_country_languages(spark, sf_dir):
    """Per country the code and citizenship seen first, and languages and codes in first-seen order."""
    seen = G.with_ordinal(_bindings(spark, sf_dir), ["country_label", "ordinal", "country", "language_code", "citizenship", "country_code"])
    return G.collect_country_languages(G.complete_bindings(G.normalize_names(seen)))


_COUNTS_SQL = S.with_inputs(
    "SELECT (SELECT count(*) FROM gcomplete) AS n_language_rows, "
    "(SELECT count(DISTINCT language_code) FROM gcomplete) AS n_codes, "
    "(SELECT count(DISTINCT country_name) FROM gcomplete) AS n_countries, "
    "(SELECT count(*) FROM gnorm) - (SELECT count(*) FROM gcomplete) AS n_skipped_rows", _triples_cte())


@register("language_counts", _COUNTS_SQL)
def language_counts(spark, sf_dir):
    """Language rows, distinct codes and distinct countries of the reference data,
    plus the bindings skipped for a missing field (A22)."""
    return G.language_counts(G.normalize_names(_bindings(spark, sf_dir)))


@register("language_counts_merged", _COUNTS_SQL)
def language_counts_merged(spark, sf_dir):
    """The same counts merged from stored sketches of three runs, each over the countries that fall to it; one run is stored twice."""
    normalized, root = G.normalize_names(_bindings(spark, sf_dir)), stage_path(spark, "counts")
    part = F.pmod(F.crc32("country"), F.lit(3))
    for run in (0, 1, 2, 1):
        G.store_counts(normalized.where(part == run), f"run-{run}", root)
    return G.merged_counts(spark, root)
