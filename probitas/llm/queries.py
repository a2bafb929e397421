"""The registered queries of the operators, over the given tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.llm import oracles
from probitas.llm.common import table
from probitas.stages import owned

QUERIES: dict = {}
# The other queries' results (models, fingerprints, checksums, tokenizers) are tested against brute force.
ORACLE_SQL: dict = {"op1_vector_graph": oracles.VECTOR_GRAPH, "op3_url_reputation": oracles.URL_REPUTATION,
                    "op8_byte_shards": oracles.BYTE_SHARDS, "op12_hard_negatives": oracles.HARD_NEGATIVES, "op13_merkle_manifest": oracles.MERKLE_MANIFEST}


def query(fn):
    QUERIES[fn.__name__] = owned(fn)
    return fn


@query
def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the fixed rules, else by its host's shrunken reputation; pages that a rule fits
    are the labelled outcomes."""
    from probitas.llm.url_reputation import Rule, judge_urls
    rules = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near-equal bytes."""
    from probitas.llm.sharding import shard_by_bytes
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into windows of 2048 tokens."""
    import public_tokenizers
    from probitas.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by chunks and decoded again, as digests."""
    import public_tokenizers
    from probitas.llm.chunked_bpe import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query
def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word SimHash, linked at two or fewer differing bits."""
    from probitas.llm.simhash import simhash_components
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by voting rules, weighed without labels."""
    from probitas.llm.quality_rules import judge_quality
    out = judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def held_out_fold(doc_id, folds: int):
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


@query
def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a line CRF learnt from labels outside of fold 0 of 5."""
    from probitas.llm.line_crf import score_documents
    labels = table(spark, sf_dir, "labels").where(held_out_fold(F.col("doc_id"), 5) != 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, labels)
    return out.select("doc_id", F.coalesce(held_out_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of equal label linked at a cosine of 0.93 or more."""
    from probitas.llm.vector_graph import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that also start in a document of smaller id."""
    from probitas.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)


@query
def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a Katz model learnt from those outside of fold 2 of 7."""
    from probitas.llm.katz import score_documents
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(held_out_fold(F.col("doc_id"), 7) == 2, F.lit(False))
    out = score_documents(docs, ~held_out)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed by best fit into sequences of 2048 tokens; only longer ones are cut."""
    import public_tokenizers
    from probitas.llm.best_fit import pack_best_fit
    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in hash trees by language, with a proof each; a seventh of them is found with one more in n_chars."""
    from probitas.llm.merkle import build_manifest
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return build_manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", found, with_proof=False)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector against all; every seventh vector's label is moved on by one first."""
    from probitas.llm.hard_negatives import mine_hard_negatives
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)
