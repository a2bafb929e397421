"""Results must not change when the input is split otherwise between building a query and reading it; stages own their tables."""

import os
import tempfile

import pytest
from llm.katz_brute import Brute, toks
from llm.test_duplicates import passages, plain_removal
from llm.test_quality_and_lm import katz_texts
from pyspark.sql import functions as F

from probitas import stages
from probitas.llm import katz, queries, suffix_dedup
from probitas.session import checkpoint_root

SPLITS = [("spark.sql.files.minPartitionNum", "1"), ("spark.sql.files.maxPartitionBytes", "2000"), ("spark.sql.files.openCostInBytes", "1")]


@pytest.fixture
def resplit(spark):
    """Reads tables in one way while queries are built and in another when they are read."""
    before = {k: spark.conf.get(k, None) for k, _ in SPLITS}
    yield lambda k: spark.conf.set(*SPLITS[k])
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark, df):
    path = tempfile.mkdtemp(prefix="probitas-splits-", dir="/tmp") + "/docs"
    df.repartition(7).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("change", [0, 1])
def test_removal(spark, docs, resplit, change):
    texts = passages(13, 200)
    out = suffix_dedup.remove_repeats(stored(spark, docs(texts)))
    resplit(change)
    resplit(2)
    got = {r.doc_id: r for r in out.collect()}
    want = plain_removal([t.encode() for t in texts], range(len(texts)), 50)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for _, r in sorted(got.items())] == want


@pytest.mark.parametrize("change", [0, 1])
def test_katz(spark, docs, resplit, change):
    texts = katz_texts(3, 120)
    out = katz.score_documents(stored(spark, docs(texts)), F.col("doc_id") % 3 != 1)
    resplit(change)
    resplit(2)
    model = Brute([t for k, t in enumerate(texts) if k % 3 != 1])
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(toks(t)) and abs(got[k].score - model.score(t)) < 1e-6 and abs(got[k].base_score - model.base(t)) < 1e-6


def test_stages_own_their_tables(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    root = f"{checkpoint_root(spark)}/stages"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    groups = queries.QUERIES["op9_simhash_pigeonring"](spark, sf)  # built, not yet read
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lazy = P.simhash_groups(spark, P.simhash_groups(spark, docs, sf), sf)  # the second stage reads the first one's tables
    rows = lazy.count()
    packed = P.run(spark, sf)
    assert groups.count() == docs.count() and 0 < rows <= docs.count()
    n = packed.count()
    for df in (groups, packed):
        stages.release(df)
    P.simhash_groups(spark, docs, sf)  # what stages called one by one have left goes with the next one
    for df in P._BEFORE:
        stages.release(df)
    assert n > 0 and set(os.listdir(root)) == before
