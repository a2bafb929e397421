"""Merkle manifest of a dataset: a hash tree per group of rows, a tree over the groups, and a proof for every row.

Rows are numbered within their tree by a range sort. 2 ** ``bits`` consecutive nodes are a superblock, which
reduces to one node by itself, so the layers of superblocks go up by one grouped reduction each. On the way down every
superblock is cogrouped with the outer nodes that its rows need, the siblings on the path from the superblock to the root:
one ``applyInPandas`` call reduces the superblock again, joins its inner siblings to the outer ones and folds the
leaves. No task sees more than a superblock and one path, whatever the size of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.llm.common import materialize, ship_package

NODES = "tree string, pos long, n long, digest string, label string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(nodes: list[str], n: int, bits: int) -> list[list[str]]:
    """A superblock's nodes, level by level, until its tree of ``n`` nodes or the superblock is one node."""
    out = [nodes]
    for _ in range(bits):
        if n == 1:
            break
        row = out[-1]
        out.append([digest("".join(row[k:k + 2])) for k in range(0, len(row), 2)])
        n = (n + 1) // 2
    return out


def steps(rows: list[list[str]], at: int) -> list[str]:
    """The way up from node ``at``: a sibling to the left or right as ``l`` or ``r`` and its digest, ``-`` for none."""
    out = []
    for row in rows[:-1]:
        other = at ^ 1
        out.append(("l" if at & 1 else "r") + row[other] if other < len(row) else "-")
        at >>= 1
    return out


def fold(leaf: str, path: list[str]) -> str:
    for step in path:
        leaf = digest(step[1:] + leaf if step[0] == "l" else leaf + step[1:])
    return leaf


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values one after the other: ``-`` for null, else UTF-8 length, ``:`` and value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows' places within their ``tree`` (pos, from 0) and the tree's size (n), in ``order``, nulls first.

    Equal rows are told apart by where they were read, so that no key is too large for one task.
    """
    columns = df.columns
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column(0).to_pylist():
                place = place + 1 if tree == last else 0
                last = tree
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
                                             names=[*columns, "__part", "__place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __part int, __place long"
    placed = materialize(df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .select(*columns).mapInArrow(count, schema), name)
    whole = Window.partitionBy("tree")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (placed.groupBy("tree", "__part").agg(F.count("*").alias("__n"))  # a row per tree and partition
              .select("tree", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(whole).alias("n")))
    return (placed.join(firsts, ["tree", "__part"])
            .select(*columns, (F.col("__place") + F.col("__first")).alias("pos"), "n"))


def climb(nodes: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """Layers of superblocks: the given nodes first, one node per tree last."""
    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        first = block.iloc[0]
        n = int(first.n)
        return pd.DataFrame({"tree": [first.tree], "pos": [int(first.pos) >> bits], "n": [-(-n >> bits)],
                             "digest": [levels(block.digest.tolist(), n, bits)[-1][0]], "label": [None]})

    layers, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0  # one number
    while True:
        layers.append(materialize(layers[-1].groupBy("tree", F.shiftright("pos", bits)).applyInPandas(top, NODES), name))
        most = -(-most >> bits)
        if most <= 1:
            return layers


def descend(layers: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """The paths of the lowest layer's superblocks, from those of the trees' last nodes: (tree, pos, subroot, path)."""
    for layer in reversed(layers[1:-1]):
        outer = expand(layer, outer, bits)
    return outer


def expand(layer: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """The path to the root of every node of a layer, from those of its superblocks."""
    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        rows = levels(block.digest.tolist(), int(block.n.iloc[0]), bits)
        path, subroot = list(above.path.iloc[0]), above.subroot.iloc[0]
        return pd.DataFrame({"tree": block.tree, "pos": block.pos, "subroot": subroot, "label": block.label, "digest": block.digest,
                             "path": [steps(rows, k) + path for k in range(len(block))]})

    return (layer.groupBy("tree", F.shiftright("pos", bits)).cogroup(outer.groupBy("tree", "pos"))
            .applyInPandas(join, "tree string, pos long, subroot string, label string, digest string, path array<string>"))


def build_manifest(rows: DataFrame, fields: list[str], tree_col: str, id_col: str, seen: Mapping[str, Column] | None = None,
                   bits: int = 10, with_proof: bool = True) -> DataFrame:
    """One row per row: ``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, proof.

    ``fields`` are hashed in their order. Rows with equal ``tree_col`` form a tree, by ``id_col`` ascending; the trees'
    last nodes form another, by ``tree_col`` bytewise. ``seen`` gives what a reader finds now in place of some
    fields; folded_root folds that reader's leaf along the manifest's siblings, and verified says whether it meets the
    root. ``proof`` has a step per level: ``l`` or ``r`` and the digest of the sibling on that side, ``-`` for none.

    Defined cases: a null ``tree_col`` is a tree of its own, the first; null ids come first in their tree; rows of
    equal id are ordered by leaf, and repeated rows stand side by side; a null field is ``-``, an empty text ``0:``;
    texts of any length are hashed whole; an empty table gives an empty result; columns of other names are ignored.
    """
    spark = rows.sparkSession
    ship_package(spark)
    id_type = rows.schema[id_col].dataType.simpleString()
    # "" for null, else "=" and the value: the order of these is the trees' order
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"), F.col(id_col).alias("__id"),
                         leaf_digest([F.col(c) for c in fields]).alias("digest"), _found(fields, seen or {}).alias("found"))
    leaves = numbered(leaves, ["__id", "digest"], "merkle-leaves").withColumn("__id", F.col("__id").cast("string"))
    layers = climb(leaves.select("tree", "pos", "n", "digest", F.lit(None).cast("string").alias("label")), bits, "merkle-layer")

    tops = numbered(layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("label"), "digest"), ["label"], "merkle-tops")
    upper = climb(tops.select("tree", "pos", "n", "digest", "label"), bits, "merkle-upper")
    root = (upper[-1].first() or {"digest": None})["digest"]  # one row
    start = upper[-1].select("tree", "pos", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("path"))
    named = expand(tops, descend(upper, start, bits), bits)  # a path for every tree
    outer = descend(layers, named.select(F.col("label").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path"), bits)

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        own = block.digest.tolist()
        rows = levels(own, int(block.n.iloc[0]), bits)
        path = list(above.path.iloc[0])
        proofs = [steps(rows, k) + path for k in range(len(own))]
        now = [b or a for a, b in zip(own, block.found)]
        return pd.DataFrame({"id": block.id.tolist(), "leaf": own, "subroot": above.subroot.iloc[0],
                             "proof_sha256": [digest("".join(s[1:] for s in p)) for p in proofs],
                             "folded_root": [fold(a, p) for a, p in zip(now, proofs)],
                             "proof": proofs if with_proof else None})

    out = (leaves.withColumnRenamed("__id", "id").groupBy("tree", F.shiftright("pos", bits)).cogroup(outer.groupBy("tree", "pos"))
           .applyInPandas(finish, "id string, leaf string, subroot string, proof_sha256 string, folded_root string, proof array<string>")
           .select(F.col("id").cast(id_type).alias(id_col), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256",
                   "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"), "proof"))
    return out if with_proof else out.drop("proof")


def _found(fields: list[str], seen: Mapping[str, Column]) -> Column:
    """The leaf a reader finds, null where it is that of the manifest."""
    if not seen:
        return F.lit(None).cast("string")
    changed = [~F.col(c).eqNullSafe(v) for c, v in seen.items()]
    any_changed = changed[0]
    for c in changed[1:]:
        any_changed = any_changed | c
    return F.when(any_changed, leaf_digest([seen.get(c, F.col(c)) for c in fields]))
