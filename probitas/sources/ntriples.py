"""N-Triples files as a triples table (subject, predicate, object, lang), and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r"<[^>]*>|_:\S+"
_LINE = rf'^\s*({_TERM})\s*(<[^>]*>)\s*({_TERM}|"(?:[^"\\]|\\.)*")(?:@([A-Za-z0-9-]+)|\^\^<[^>]*>)?\s*\.\s*(?:#.*)?$'
_BACKSLASH = "￿"  # stands for an escaped backslash meanwhile; never a character of a text


def _unescape(text: Column) -> Column:
    """The characters that the escapes of a literal stand for."""
    kept = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit("\\'"), F.lit("'"))
    wide = F.array_distinct(F.regexp_extract_all(kept, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1)))
    kept = F.aggregate(wide, kept, lambda done, h: F.replace(done, F.concat(F.lit("\\U"), h), F.decode(F.unhex(h), "UTF-32")))
    plain = F.from_json(F.concat(F.lit('["'), kept, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    return F.replace(F.get(plain, 0), F.lit(_BACKSLASH), F.lit("\\"))


def _term(text: Column, base: str) -> Column:
    """An entity's name: an IRI without its brackets and, where it begins with it, without ``base``."""
    iri = F.when(text.startswith("<"), text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.when(iri.startswith(base), iri.substr(F.lit(len(base) + 1), F.length(iri))).otherwise(iri) if base else iri


def scan_ntriples(spark: SparkSession, path: str, base: str = "") -> tuple[DataFrame, DataFrame]:
    """(triples, broken): the statements of all files under ``path``, and the lines that are none.

    Blank lines and comments are neither. Literals keep their language tag in ``lang`` (lower case as written) and lose their
    datatype; escapes are resolved; repeated statements stay.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    parsed = lines.where(F.col("value").rlike(_LINE)).select(
        part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.nullif(part(4), F.lit("")).alias("lang"))
    literal = _unescape(F.col("o").substr(F.lit(2), F.length("o") - 2))
    triples = parsed.select(_term(F.col("s"), base).alias("subject"), _term(F.col("p"), base).alias("predicate"),
                            F.when(F.col("o").startswith('"'), literal).otherwise(_term(F.col("o"), base)).alias("object"), "lang")
    return triples, lines.where(~F.col("value").rlike(_LINE)).select(F.col("value").alias("line"))


def write_ntriples(triples: DataFrame, is_entity: Column, path: str, base: str) -> None:
    """Triples as N-Triples: names are IRIs under ``base``, objects too where ``is_entity``, else literals with their tag."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.col(c), F.lit(">"))
    text = F.col("object")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(""))
    triples.select(F.concat(iri("subject"), F.lit(" "), iri("predicate"), F.lit(" "), F.when(is_entity, iri("object")).otherwise(literal),
                            F.lit(" ."))).write.mode("overwrite").text(path)
