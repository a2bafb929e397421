"""The Merkle manifest against trees built whole, for many sizes and superblocks."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from probitas.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, **found):
    values = [found.get(c, row[c]) for c in FIELDS]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h("".join(rows[-1][k:k + 2])) for k in range(0, len(rows[-1]), 2)])
    return rows


def way(rows, at):
    out = []
    for row in rows[:-1]:
        out.append((at & 1, row[at ^ 1] if at ^ 1 < len(row) else None))
        at //= 2
    return out


def brute(docs, tampers):
    """Sorted (id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((d for d in docs if d["lang"] == x), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d))) for x in langs}
    trees = {x: tree([leaf(d) for d in g]) for x, g in groups.items()}
    upper = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, d in enumerate(groups[x]):
            path = way(trees[x], at) + way(upper, k)
            node = leaf(d, n_chars=d["n_chars"] + 1) if tampers(d) else leaf(d)
            for left, other in path:
                node = h(other + node if left and other else node + (other or ""))
            out.append((d["doc_id"], leaf(d), trees[x][-1][0], upper[-1][0], h("".join(s for _, s in path if s)), node, node == upper[-1][0]))
    return sorted(out, key=repr)


def tampered(d):
    return d["doc_id"] is not None and d["n_chars"] is not None and crc32(str(d["doc_id"]).encode()) % 7 == 0


@pytest.fixture
def found(spark):
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_equals_whole_trees(spark, found, bits):
    rng = random.Random(bits)
    sizes = {None: 1, "": 2, "en": 150, "de": 17, "fr": 64, "é": 1, "Z": 5}
    docs = [dict(doc_id=rng.randint(0, 10 ** 12), source=rng.choice([None, "", "web"]), lang=lang, n_chars=rng.choice([None, 3, -1]),
                 text=rng.choice([None, "", "漢字 text", "x" * 70_000]), digest="a", tree="b", pos="c", found="d", verified="e")
            for lang, n in sizes.items() for _ in range(n)]
    docs += [dict(docs[9]) for _ in range(40)]  # a repeated row
    docs += [docs[20] | {"text": "same id"}, docs[20] | {"doc_id": None}, docs[21] | {"doc_id": None}]
    rng.shuffle(docs)
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, source string, lang string, n_chars long, text string, "
                               "digest string, tree string, pos string, found string, verified string").repartition(3)
    out = merkle.build_manifest(df, FIELDS, "lang", "doc_id", found, bits=bits)
    got = out.collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == brute(docs, tampered)
    assert sum(not r.verified for r in got) == sum(map(tampered, docs)) > 0
    for r in got:  # the returned proof verifies by itself
        assert merkle.fold(r.leaf, r.proof) == r.root and h("".join(s[1:] for s in r.proof)) == r.proof_sha256


def test_empty_table_and_single_rows(spark, found):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = spark.createDataFrame([], schema)
    assert merkle.build_manifest(empty, FIELDS, "lang", "doc_id", found).collect() == []
    one = [dict(doc_id=None, source=None, lang=None, n_chars=None, text=None)]
    got = merkle.build_manifest(spark.createDataFrame([(None,) * 5], schema), FIELDS, "lang", "doc_id").collect()
    assert [tuple(r)[:-1] for r in got] == brute(one, lambda d: False)
    assert got[0].root == got[0].leaf and got[0].proof == [] and got[0].proof_sha256 == h("")


def test_every_length_of_a_tree(spark, found):
    rows = [(k, None, f"{n:02d}", 1, "t") for n in range(1, 35) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = [dict(zip(FIELDS, (r[0], r[1], r[2], r[3], r[4]))) for r in rows]
    got = merkle.build_manifest(df, FIELDS, "lang", "doc_id", found, bits=2, with_proof=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, tampered)
