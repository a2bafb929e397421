"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. :func:`run` applies them in order. A stage owns what its operators stage on the way to its
result; once that result is written, its tables are deleted, by :func:`run` itself or, where stages are called one by one, when
the next stage begins and its input does not read them. Nobody else's tables are touched.

Defined cases, for every stage: an empty table stays empty; null and empty texts, null and repeated ids, repeated rows and texts
of any length are judged row by row as the stage's operator states; columns beyond those of documents are kept by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.llm import line_crf, packing, quality_rules, simhash, suffix_dedup
from probitas.llm.common import table
from probitas.llm.queries import held_out_fold
from probitas.session import OWNER, materialize
from probitas.stages import Owner, owned, release

_BEFORE: list[DataFrame] = []  # results of stages whose tables are still there


def stage(fn):
    """A stage that owns its tables; those of the stages before it go when their results have been written."""
    build = owned(fn)

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for df in [d for d in _BEFORE if not d.staged_by.reads(docs)]:
            release(df)
            _BEFORE.remove(df)
        out = build(spark, docs, sf_dir)
        _BEFORE.append(out)
        return out
    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores 0.3 or more; labels of fold 0 of 5 are left out of its fit."""
    labels = table(spark, sf_dir, "labels").where(held_out_fold(F.col("doc_id"), 5) != 0)
    return line_crf.keep_above(docs, labels, 0.3)


@stage
def quality_rule_votes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are good by the weighed votes of all rules."""
    return quality_rules.keep_good(docs)


@stage
def simhash_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at two or fewer bits of 3-word SimHash."""
    return simhash.keep_one_per_group(docs, shingle=3, max_bits=2)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that also start in a document of smaller id."""
    return suffix_dedup.strip_repeats(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed into windows of 2048 tokens."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_votes),
    ("simhash near-dedup", simhash_groups),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed_sequences),
]

ORACLE_SQL = None  # iterative models, fingerprints and tokenizers cannot be written in SQL


@owned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        result = step(spark, docs, sf_dir)
        with Owner(spark, name) as owner:
            docs = materialize(result, f"pipeline-{name.replace(' ', '-')}")
        release(result)
        _BEFORE.remove(result)
        if before is not None:
            before.release()  # the input of this stage has been read
        before = owner
    OWNER.get().paths.extend(before.paths)  # the last table is the result's
    return docs
