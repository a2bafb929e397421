"""SimHash groups, vector graph, components and repeated passages, each against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from probitas.llm import simhash, suffix_dedup, vector_graph
from probitas.llm.components import connected_components, join_sets, tree_edges


def plain_components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (9, 3), (3, 9), (140, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = plain_components(300, edges)
    assert got == {v: want[v] for e in edges for v in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_tree_edges_connect_sets_with_few_edges():
    parent = join_sets(np.arange(50), np.array([1, 2, 3, 40]), np.array([2, 3, 4, 41]))
    a, b = tree_edges(parent)
    assert plain_components(50, zip(a.tolist(), b.tolist())) == parent.tolist()
    assert np.bincount(np.concatenate([a, b])).max() <= 3


# ---- SimHash

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints(odd_texts):
    for t in [*odd_texts, "a b", "a b c", "A  b\tC d"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_by_pigeonring_are_all_links(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)  # so that large buckets are split
    rng = random.Random(bits)
    fps = set()
    while len(fps) < 250:
        base = rng.getrandbits(64)
        fps |= {base, *[base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(6)]}
    common = rng.getrandbits(40)
    fps |= {common | rng.getrandbits(24) << 40 for _ in range(150)}  # many share segments
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    place = {f: k for k, f in enumerate(signed)}
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits]
    assert plain_components(len(fps), [(place[e.src], place[e.dst]) for e in edges]) == plain_components(len(fps), links)


def test_simhash_components_and_keeping(docs, odd_texts):
    texts = odd_texts + [odd_texts[5].replace("lazy", "idle")]
    fps = [plain_fingerprint(t) for t in texts]
    n = len(texts)
    comp = plain_components(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    table = docs(texts)
    got = {r.doc_id: (int(np.int64(r.fp).astype(np.uint64)), r.component_id) for r in simhash.simhash_components(table).collect()}
    assert got == {k: (fps[k], comp[k]) for k in range(n)}
    kept = simhash.keep_one_per_group(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    odd = docs(["same text here now"] * 4 + [None], [None, 7, 7, 9, None])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.simhash_components(odd).collect()) == [
        ("7", "7"), ("7", "7"), ("9", "7"), ("None", "7"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash.keep_one_per_group(odd).collect()) == ["7", "None"]
    assert simhash.simhash_components(docs([])).collect() == [] and simhash.keep_one_per_group(docs([])).collect() == []


# ---- vectors

def vectors(seed, blob, n, dim=24):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dim) for _ in range(n)]
    centre = rng.normal(size=dim) * 3
    x += [centre + 0.25 * rng.normal(size=dim) for _ in range(blob)]
    x += [x[k] + 0.05 * rng.normal(size=dim) for k in range(0, n, 5)]
    return [[float(np.float32(v)) for v in row] for row in x]


@pytest.mark.parametrize("cell,least", [(6000, 0.99), (150, 0.9)])
def test_vector_links_against_brute_force(spark, cell, least):
    rows = [(k, v, k % 2) for k, v in enumerate(vectors(1, 120, 400))]
    rows += [(10_000 + k, rows[3][1], 1) for k in range(3)] + [(20_000, rows[4][1], 1)]  # copies; the last in another label
    odd = [(30_000, None, 1), (30_001, [0.0] * 24, 1), (30_002, rows[0][1][:-1] + [None], 0), (30_003, rows[0][1][:-1] + [float("nan")], 0),
           (30_004, rows[0][1], None), (30_005, [], 1), (30_006, rows[0][1][:-1] + [float("inf")], 0), (30_007, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df, vector_graph.Graph(cell=cell)).collect()}
    assert len(got) == len(rows) + len(odd)
    for o in odd:
        assert (got[o[0]].n_links, got[o[0]].component_id, got[o[0]].kept) == (0, o[0], True)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    found = np.array([got[r[0]].n_links for r in rows])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= least * linked.sum()
    comp = plain_components(len(rows), zip(*np.nonzero(linked)))
    right = [got[r[0]].component_id == rows[c][0] for r, c in zip(rows, comp)]
    assert np.mean(right) >= least
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_links_of_a_group_larger_than_a_shard_are_all_counted(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(5, 700, 300))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df, vector_graph.Graph(cell=100)).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    comp = plain_components(len(rows), zip(*np.nonzero(linked)))
    assert [got[k].n_links for k in range(len(rows))] == linked.sum(axis=1).tolist()
    assert [got[k].component_id for k in range(len(rows))] == list(comp)


def test_a_shard_whose_graph_reaches_too_little_is_compared_whole():
    x = vector_graph._unit(vectors(6, 150, 200))
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    links, recall = vector_graph.audited_links(x, np.full((len(x), 1), -1, np.int64), vector_graph.Graph())
    assert recall == 1.0 and (links == want).all()


def test_adjacency_lists_of_shards_are_united():
    ids = np.array([2, 5, 7, 9])
    adj = vector_graph._adjacency(ids, [[5, 11, 9], [], [2], [1, 7, 2]])
    assert [sorted(a[a >= 0].tolist()) for a in adj] == [[1, 3], [], [0], [0, 2]]
    assert (vector_graph._adjacency(ids, [[1]] * 4) == -1).all()


def test_recall_is_unmeasured_without_links_and_found_where_links_are_rare():
    x = vector_graph._unit(np.random.default_rng(3).normal(size=(600, 24)))
    links, recall = vector_graph.audited_links(x, vector_graph.build(x, vector_graph.Graph()), vector_graph.Graph())
    assert not links.any() and np.isnan(recall)
    x[17] = x[400]  # one pair among 600 vectors
    sample, truth = vector_graph.audit_sample(x, vector_graph.Graph())
    assert sorted(sample.tolist()) == [17, 400] and truth.sum() == 2


def test_rare_links_among_many_vectors_at_production_settings(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 1.5
    x = centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 16))
    x[:100] = x[100:200] + 0.03 * rng.normal(size=(100, 16))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(8)
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df).collect()}
    u = vector_graph._unit(x)
    n_links = np.concatenate([(u[at:at + 1000] @ u.T >= 0.93).sum(axis=1) - 1 for at in range(0, len(u), 1000)])
    found = np.array([got[k].n_links for k in range(len(x))])
    print("links", n_links.sum(), "found", found.sum(), "recall", sorted({str(r.recall) for r in got.values()}))
    assert (found <= n_links).all() and n_links.sum() >= 200 and found.sum() >= 0.9 * n_links.sum()


def test_no_vectors(spark):
    assert vector_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_robust_pruning_keeps_the_nearest_and_drops_what_it_hides():
    angle = np.radians([0, 5, 6, 90])
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    out = vector_graph.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 0, 2]]), 4, 1.2)
    assert out[0].tolist() == [1, 3, -1, -1]  # 2 is hidden by 1; 3 is hardly nearer to 1 than to the point


# ---- repeated passages

def plain_removal(texts, ids, length):
    first = {}
    for t, i in zip(texts, ids):
        for k in range(len(t) - length + 1):
            s = t[k:k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for t, i in zip(texts, ids):
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k:k + length]] < i:
                gone[k:k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abeé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(" ".join(word() for _ in range(rng.randint(0, 30))))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                at = rng.randint(0, len(s) // 3)
                parts.append(s[at:len(s) - rng.randint(0, len(s) // 3)])
        out.append(" ".join(parts))
    return out + ["ab" * 400, "ab" * 300, "x" + "ab" * 200, "a" * 700, "a" * 49, "a" * 50]


@pytest.mark.parametrize("how", [suffix_dedup.Repeats(), suffix_dedup.Repeats(frequent=0.004), suffix_dedup.Repeats(length=20)])
def test_removal_against_brute_force(spark, docs, odd_texts, how, monkeypatch):
    texts = passages(11, 150) + odd_texts[:7]
    rng = random.Random(2)
    ids = rng.sample(range(1000), len(texts))
    ids[5:8] = [None, None, ids[4]]  # null ids, and an id twice
    order = [suffix_dedup.NULL_ID if i is None else i for i in ids]
    got = suffix_dedup.remove_repeats(docs(texts, ids).repartition(5), how).collect()
    want = plain_removal([(t or "").encode() for t in texts], order, how.length)
    assert len(got) == len(texts)
    seen = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got)
    assert seen == sorted((str(i), *w) for i, w in zip(ids, want))
    assert sum(w[1] for w in want) > 1000 and all(r.source == "s" for r in got)
    for r in got:
        assert sum(z - a for a, z in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("conf", [("maxBytesPerBatch", "2000"), ("maxRecordsPerBatch", "3")])
def test_removal_does_not_depend_on_batch_ends(spark, docs, conf):
    """The last scan reads more columns than the first ones, so that its batches end earlier."""
    texts = passages(12, 150)
    wide = docs(texts).withColumn("source", F.repeat(F.lit("s"), 300)).repartition(3)
    name = f"spark.sql.execution.arrow.{conf[0]}"
    before = spark.conf.get(name)
    spark.conf.set(name, conf[1])
    try:
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(wide).collect()}
    finally:
        spark.conf.set(name, before)
    want = plain_removal([t.encode() for t in texts], range(len(texts)), 50)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for _, r in sorted(got.items())] == want
    assert all(r.source == "s" * 300 for r in got.values())


def test_an_anchor_repeated_in_few_texts_is_dealt_over_shards(docs, monkeypatch):
    """15 of 400 texts say one word over and over: few texts, but most of all anchors."""
    meet = suffix_dedup._meet

    def bounded(how, lots):
        def run(part):
            anchors = sum(len(b) for b in part["entries"]) // sum(np.dtype(k).itemsize for k in suffix_dedup.ENTRY.values())
            if anchors > 15_000:
                raise ValueError(f"{anchors} anchors in a shard")
            return real(part)
        real = meet(how, lots)
        return run

    monkeypatch.setattr(suffix_dedup, "_meet", bounded)
    texts = passages(14, 400)
    for k in range(15):
        texts[20 * k] = "the " * (2400 + k) + f"end {k}"
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(texts).repartition(4)).collect()}
    want = plain_removal([t.encode() for t in texts], range(len(texts)), 50)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for _, r in sorted(got.items())] == want


def test_contexts_of_an_anchor_in_several_parts(docs):
    texts = passages(15, 150)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(texts).repartition(3), suffix_dedup.Repeats(part=500)).collect()}
    want = plain_removal([t.encode() for t in texts], range(len(texts)), 50)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for _, r in sorted(got.items())] == want


def test_parts_are_bounded_and_keep_anchors_together():
    rng = np.random.default_rng(3)
    a = np.sort(np.concatenate([rng.integers(0, 500, 2000), np.full(3000, 77)]))
    size = rng.integers(50, 85, len(a))
    part, wide = suffix_dedup._parts(a, size, 10_000)
    assert np.bincount(part, size).max() <= 20_000 + 84 and set(a[wide > 0]) == {77}
    assert all(len(set(part[a == x])) == 1 for x in set(a.tolist()) - {77})
    assert all(len(x) == 0 for x in suffix_dedup._parts(a[:0], size[:0], 10_000))


def test_a_few_partitions_do_not_make_shards_large(docs, monkeypatch):
    deal, made = suffix_dedup._deal_anchors, []
    monkeypatch.setattr(suffix_dedup, "_deal_anchors", lambda how, shards, *x: made.append(shards) or deal(how, shards, *x))
    texts = passages(16, 60)
    suffix_dedup.remove_repeats(docs(texts), suffix_dedup.Repeats(shard=50))
    assert made[0] >= 2 * sum(len(t.encode()) for t in texts) // (36 * 50) > 20


def test_stripping_keeps_columns_and_whole_characters(docs):
    passage = "é" * 60
    out = {r.doc_id: r for r in suffix_dedup.strip_repeats(docs([passage, "x" + passage + "é!", None])).collect()}
    assert out[0].text == passage and out[0].n_chars == 60 and out[0].kept == "z"
    assert out[1].text == "xé!" or out[1].text == "x!" and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[2].n_chars) == ("", 0)
    assert suffix_dedup.strip_repeats(docs([])).collect() == []


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    rng = random.Random(8)
    t = bytes(rng.choices(b"abc ", k=5000))
    row, pos, a, c, lo, hi, *_ = suffix_dedup.text_anchors([t, b"short", t[100:]], 50)
    covered = {(r, s) for r, p, b, f in zip(row.tolist(), pos.tolist(), lo.tolist(), hi.tolist()) for s in range(p - b, p + f - 49)}
    assert covered >= {(0, s) for s in range(4951)} | {(2, s) for s in range(4851)}


@pytest.mark.parametrize("packed", [21, 4])
def test_suffix_array_and_common_prefixes(packed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PACKED", packed)  # few bits: the way of large arrays
    rng = random.Random(9)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(40)]
    at, group, text, offset, words = suffix_dedup.equal_windows(texts, 12)
    key = suffix_dedup.window_keys(words, at, 12)
    got = {}
    for t, o, g, k in zip(text[at].tolist(), offset[at].tolist(), group.tolist(), key.tolist()):
        got.setdefault(g, set()).add((texts[t][o:o + 12], k))
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v))[0] for v in got.values()}) == len(got)
    assert len(at) == sum(max(0, len(t) - 11) for t in texts)
