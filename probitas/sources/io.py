"""Sources and sinks: delimited answer files, the answer store, JSON map documents.

Parquet partitioned by (scenario, model) is the primary store: the answer-file
lookup by (scenario, model, key) becomes partition pruning plus a pushed-down
filter. The ``;``-delimited files of the original layout
``<root>/<scenario>/<model>/rm_answers_<key>.csv`` (model names may contain
``/``) are read in one recursive scan, with scenario, model and key parsed from
each row's file path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas import rules as R
from probitas.operators.units import UNIT
from probitas.sources.store import lookup, read_store, store_exists

# Fixed value: the column header of an answer file, in file order.
ANSWER_FILE_COLUMNS = [
    "criterion_id", "Fact", "Support", "Opposition", "Stance", "Fact Coherence", "Fact Validity",
    "Fact Weight coherence by validity", "Stance Coherence", "Stance Validity",
    "Stance Weight coherence by validity",
]
# our column names for the same fields
ANSWER_COLUMNS = ["criterion_id", "fact", "support", "opposition", "stance", "fact_coherence", "fact_validity",
                  "fact_weighted", "stance_coherence", "stance_validity", "stance_weighted"]

ANSWER_FILE_SCHEMA = T.StructType(
    [T.StructField("criterion_id", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ANSWER_FILE_COLUMNS[1:]])

# Fixed value: file-name prefix of an answer file (``<prefix><key>.csv``).
ANSWER_FILE_PREFIX = "rm_answers_"

_SCEN = "|".join(R.SCENARIOS)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";",
                   header: bool = True) -> DataFrame:
    """Delimited scan with an explicit schema (no inference)."""
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("mode", "PERMISSIVE").csv(path))


def read_checked(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";",
                 header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Delimited scan that tells broken records apart: (rows, broken).

    A record with a cell that is not of its column's type, or with too few or too many cells, is in ``broken``: its file, its
    text (``record``) and what could be read of it as JSON (``cells``). All columns are parsed whichever are asked for, so that
    a record is broken or not whatever the query reads.
    """
    raw = (spark.read.schema(T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]))
           .option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
           .csv(path))
    columns = [F.col(f"`{f.name}`") for f in schema.fields]
    whole = F.pmod(F.xxhash64(*columns), F.lit(2)) >= 0  # always true; it needs every column, so none is left unparsed
    broken = raw.where(F.col("_broken").isNotNull() & whole).select(
        F.col("_metadata.file_path").alias("file"), F.col("_broken").alias("record"), F.to_json(F.struct(*columns)).alias("cells"))
    return raw.where(F.col("_broken").isNull() & whole).select(*columns), broken


def quarantine(broken: DataFrame, root: str) -> None:
    """Keep broken records for a look at them: JSON lines, added to what is there already."""
    broken.write.mode("append").json(root)


def write_delimited(df: DataFrame, path: str, sep: str = ";", partition_by: list[str] | None = None) -> None:
    """Delimited sink with header."""
    w = df.write.mode("overwrite").option("sep", sep).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_matrix(spark: SparkSession, path: str, row_label: str = "model", sep: str = ",") -> DataFrame:
    """A matrix file whose first, unnamed header column holds the row labels."""
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    return df.withColumnRenamed(df.columns[0], row_label)


def scan_keyed_files(spark: SparkSession, root: str, prefix: str, schema: T.StructType) -> DataFrame:
    """Every ``<root>/<scenario>/[<sub dirs>/]<prefix><key>.csv`` file under ``root`` in one
    recursive scan, with ``scenario``, ``subpath`` (e.g. the model) and ``unit_key``
    parsed from each row's file path (S3, S4)."""
    raw = (spark.read.schema(schema).option("sep", ";").option("header", True)
           .option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.csv").csv(root))
    pattern = rf"/({_SCEN})/(?:(.+)/)?{prefix}([^/]+)\.csv$"
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, pattern, 1).alias("scenario"),
                      F.regexp_extract(path, pattern, 2).alias("subpath"),
                      F.regexp_extract(path, pattern, 3).alias("unit_key"), "*")


def scan_answer_files(spark: SparkSession, root: str) -> DataFrame:
    """All answer files under ``root`` in the original layout, as long rows with
    scenario, model and unit_key parsed from the file path (S3)."""
    raw = scan_keyed_files(spark, root, ANSWER_FILE_PREFIX, ANSWER_FILE_SCHEMA)
    return raw.select("scenario", F.col("subpath").alias("model"), "unit_key",
                      *[F.col(f"`{src}`").alias(dst) for src, dst in zip(ANSWER_FILE_COLUMNS, ANSWER_COLUMNS)])


def write_answer_store(item_scores: DataFrame, root: str) -> None:
    """Answer store sink: Parquet partitioned by (scenario, model)."""
    item_scores.write.mode("overwrite").partitionBy("scenario", "model").parquet(root)


def append_answer_store(item_scores: DataFrame, root: str) -> None:
    """Add rows to the answer store; the caller sees to it that their units are new."""
    item_scores.write.mode("append").partitionBy("scenario", "model").parquet(root)


def scan_answer_store(spark: SparkSession, root: str, scenario: str | None = None, model: str | None = None,
                      unit_key: str | None = None, units: DataFrame | None = None) -> DataFrame:
    """Answer rows from the store; the optional lookup keys become partition
    pruning (scenario, model) and a pushed-down filter (unit_key) (S3, S4). A store that is upserted
    (:mod:`probitas.sources.store`) is read as of its latest version.

    ``units`` (scenario, model, unit_key) asks for the rows of those units only; files of other (scenario, model)
    partitions are not opened, by the list of a versioned store or by dynamic pruning when the scan of a plain one runs.
    """
    if units is not None and store_exists(spark, root):
        df = lookup(spark, root, units, UNIT)
    elif units is not None:
        plain = spark.read.parquet(root)
        # a row per scenario and model, as many as the store can have folders; the comparisons are never false for such a
        # folder, and a set that is filtered is one that Spark prunes by
        parts = units.where((F.col("scenario") > "") & (F.col("model") > "")).select("scenario", "model").distinct()
        df = (plain.join(F.broadcast(parts), ["scenario", "model"], "left_semi")
              .join(units.select(*UNIT).distinct(), UNIT, "left_semi").select(*plain.columns))
    else:
        df = read_store(spark, root) if store_exists(spark, root) else spark.read.parquet(root)
    for c, v in (("scenario", scenario), ("model", model), ("unit_key", unit_key)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


QUESTION_COLUMNS = ["criterion_id", *R.QUESTION_TYPES]
QUESTION_SCHEMA = T.StructType([T.StructField("criterion_id", T.IntegerType())]
                               + [T.StructField(c, T.StringType()) for c in R.QUESTION_TYPES])


def write_questionnaires(questionnaire: DataFrame, root: str) -> None:
    """Questionnaires as ``;`` files with the columns of a question file, a folder per scenario and unit key."""
    named = questionnaire.select("scenario", "unit_key", "criterion_id", *[F.col(t.lower()).alias(t) for t in R.QUESTION_TYPES])
    (named.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"')
     .partitionBy("scenario", "unit_key").csv(root))


def _question_rows(raw: DataFrame) -> DataFrame:
    return raw.select("scenario", "unit_key", "criterion_id", *[F.col(t).alias(t.lower()) for t in R.QUESTION_TYPES])


def scan_questionnaires(spark: SparkSession, root: str) -> DataFrame:
    """Questionnaires written by :func:`write_questionnaires`; lookups by scenario and unit key prune folders."""
    schema = T.StructType([*QUESTION_SCHEMA.fields, T.StructField("scenario", T.StringType()), T.StructField("unit_key", T.StringType())])
    return _question_rows(spark.read.schema(schema).option("sep", ";").option("header", True).option("escape", '"')
                          .option("multiLine", True).csv(root))


def scan_questionnaire_files(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Questionnaires in the layout ``<root>/<scenario>/<prefix><unit key>.csv``."""
    return _question_rows(scan_keyed_files(spark, root, prefix, QUESTION_SCHEMA))


PROMPT_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("prompt", R.YES, R.NO)])


def write_prompts(prompts: DataFrame, path: str) -> None:
    """The prompt document: language to instruction and yes / no tokens; languages without them are left out."""
    write_json_map(prompts.where("status = 'ok'").select("language", "prompt", F.col("yes").alias(R.YES), F.col("no").alias(R.NO)),
                   "language", path)


def scan_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompt document as rows (language, prompt, yes, no)."""
    return scan_json_map(spark, path, PROMPT_RECORD, key="language").select("language", "prompt", R.YES, R.NO)


DOCUMENT_ROWS = 100_000  # most entries of a JSON document, which is one record


def write_json_map(df: DataFrame, key: str, path: str) -> None:
    """One JSON document mapping ``key`` to the other columns of each row (S7). For dimension
    tables: more than DOCUMENT_ROWS rows are refused, as the document is one record."""
    if df.limit(DOCUMENT_ROWS + 1).count() > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows do not belong in one JSON document")
    value = F.struct(*[c for c in df.columns if c != key])
    doc = df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def scan_json_map(spark: SparkSession, path: str, value_schema: T.StructType, key: str = "key") -> DataFrame:
    """A JSON map-of-records document to one row per entry (S5): whole-file text,
    ``from_json`` with an explicit map schema, then ``explode``."""
    doc = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), value_schema))
    return doc.select(F.explode(m).alias(key, "v")).select(key, "v.*")


def scan_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings to (pos, value) rows."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.posexplode(F.from_json("value", T.ArrayType(T.StringType()))).alias("pos", "value"))
