"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into a ring of ``2 * max_bits + 1`` segments. If two fingerprints differ in at
most ``max_bits`` bits, then from some segment on every chain of consecutive segments stays within its
proportional budget: the first l segments differ in at most ``l * max_bits / segments`` bits. The budgets of the first
segments (two, as a rule) are below one, so these must be equal: together they are the bucket key. Pairs in a
bucket must keep the budgets of the whole chain before the full Hamming distance is taken.

Equal fingerprints are one node; buckets larger than a block are split into pairs of blocks; a task emits a tree over
linked fingerprints, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas.llm.common import lookup_join, materialize, ship_package
from probitas.llm.components import connected_components, join_sets, tree_edges

SEED = 42
BLOCK = 2048  # fingerprints of a bucket that a task compares with each other
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit k is 1 if set in over half of the hashes of the text's shingles; 0 without a word."""
    ws = (text or "").encode().translate(_LOWER).split()
    if not ws:
        return 0
    joined, n = b" ".join(ws), len(ws)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in ws]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        h = np.array(hashes[at:at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(shingle: int):
    """A pandas UDF from texts to fingerprints (as signed longs)."""
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))
    return F.pandas_udf(of, "long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    m = 2 * max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def within_budgets(x: np.ndarray, start: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether the chain of differences x from segment ``start`` on stays within its budgets all around."""
    segs = segments(max_bits)
    m = len(segs)
    counts = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << w) - 1)) for a, w in segs]).astype(np.int64)
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for k in range(m):
        total += counts[(start + k) % m, rows]
        ok &= total * m <= (k + 1) * max_bits
    return ok


def _linked(keys: np.ndarray, start: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges between linked fingerprints of equal key; rows are sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff([*first, len(keys)])
    after = np.repeat(first + size, size) - np.arange(len(keys)) - 1  # rows of the same key that follow
    parent = np.arange(len(keys))
    for d in range(1, int(size.max())):
        i = np.flatnonzero(after >= d)
        i = i[parent[i] != parent[i + d]]
        if not len(i):
            continue
        i = i[within_budgets(fp[i] ^ fp[i + d], start[i], max_bits)]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        if len(i):
            parent = join_sets(parent, i, i + d)
    return tree_edges(parent)


def _compare(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            same = (part["bucket"] == part["bucket"].iloc[-1]).to_numpy() & (part["pair"] == part["pair"].iloc[-1]).to_numpy()
            cut = len(part) if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            held, part = (part, None) if cut == len(part) else (part.iloc[cut:], part.iloc[:cut])
            if part is not None:
                yield _edges(part, max_bits)
        if held is not None and len(held):
            yield _edges(held, max_bits)
    return run


def _edges(part: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    keys = part.groupby(["bucket", "pair"], sort=False).ngroup().to_numpy()
    fp = part["fp"].to_numpy().astype(np.uint64)
    a, b = _linked(keys, part["start"].to_numpy().astype(np.int64), fp, max_bits)
    return pd.DataFrame({"src": fp[a].astype(np.int64), "dst": fp[b].astype(np.int64)})


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """src, dst: edges that connect all fingerprints (column fp, distinct) with at most ``max_bits`` differing bits."""
    segs = segments(max_bits)
    m = len(segs)
    equal = (m - 1) // max_bits if max_bits else m  # segments whose budget is below one

    def bits(first: int, width: int):
        return F.col("fp") if width == 64 else F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)

    def key(i: int):
        parts = [bits(*segs[(i + k) % m]) for k in range(equal)]
        return F.struct(F.lit(i).alias("start"), F.xxhash64(F.lit(i), *parts).alias("bucket"))

    keyed = distinct.select("fp", F.explode(F.array(*[key(i) for i in range(m)])).alias("k")).select("fp", "k.start", "k.bucket")
    keyed = materialize(keyed, "buckets")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    keyed = lookup_join(keyed, sizes, "bucket", "n").where("n > 1")
    # A large bucket's rows fall into blocks; row pairs meet where their two blocks meet.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda other: F.least(other, F.col("own")) * F.col("blocks") + F.greatest(other, F.col("own")))
    dealt = (keyed.withColumn("blocks", blocks).withColumn("own", own)
             .select("bucket", "start", "fp", F.explode(meets).alias("pair"))
             .repartition("bucket", "pair").sortWithinPartitions("bucket", "pair"))
    return dealt.mapInPandas(_compare(max_bits), "src long, dst long")


def fingerprint_classes(hashed: DataFrame, max_bits: int) -> DataFrame:
    """fp, n (rows), least (the smallest struct of the other columns), class: one row per distinct fingerprint."""
    others = [c for c in hashed.columns if c != "fp"]
    distinct = materialize(hashed.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(*others)).alias("least")), "fingerprints")
    classes = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    return (distinct.join(classes, F.col("fp") == F.col("node"), "left")
            .select("fp", "n", "least", F.coalesce("component", "fp").alias("class")))


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fp (signed long), component_id (the smallest id linked to it, through others too).

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; null ids
    are grouped too, but a component of null ids alone has a null component_id; repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    hashed = materialize(docs.select(F.col(id_col).alias("id"), fingerprints(shingle)(F.col(text_col)).alias("fp")), "simhash")
    per_fp = materialize(
        fingerprint_classes(hashed.select("fp", F.col("id").isNull().alias("none"), "id"), max_bits), "simhash-classes")
    least = per_fp.groupBy("class").agg(F.min("least")["id"].alias("component_id"), F.count("*").alias("fps"))
    per_fp = lookup_join(per_fp.select("fp", "n", "class"), least, "class", "fps")
    out = lookup_join(hashed, per_fp.select("fp", "n", "component_id"), "fp", "n")
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """The documents, one of each near-duplicate group: the smallest id, then the first of repeated rows. Columns stay."""
    ship_package(docs.sparkSession)
    marked = materialize(docs.withColumn("__fp", fingerprints(shingle)(F.col(text_col)))
                         .withColumn("__row", F.monotonically_increasing_id()), "simhash-docs")
    hashed = marked.select(F.col("__fp").alias("fp"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "__row")
    kept = fingerprint_classes(hashed, max_bits).groupBy("class").agg(F.min("least")["__row"].alias("__row")).select("__row")
    return marked.join(kept, "__row", "left_semi").select(*[F.col(c) for c in docs.columns])
