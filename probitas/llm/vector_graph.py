"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label and dimension form a cell; a cell above ``Graph.cell`` vectors is split around centres fitted to a
bounded sample of it. Every vector is at home in one cell and a visitor in all others where it can be in range of one
at home: if x lies nearer to centre k and y is in range of x, then y is at most the range times the distance of the centres
nearer to any other centre. So a shard holds all that its vectors link with. Per shard a flat graph is built: nodes are
inserted in batches, each searches the graph so far and keeps a robust-pruned selection of what it visited. The adjacency lists
of a node from all shards that it is a member of are united. Every vector then searches the united graph from the medoids
among the members of its home shard, and expands as long as it finds vectors in range. Links are verified by their exact
cosine, recall is audited against brute force on vectors that have links, the search widens if it falls short, and if
that is not enough all pairs of the shard are compared. Shards above ``Graph.cell`` vectors with their visitors (dense
groups, which no split takes apart) are compared in pairs of blocks, all pairs.

Copies are one node with a multiplicity; a task emits counts and a tree over linked nodes, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas.llm.common import lookup_join, materialize, ship_package
from probitas.llm.components import connected_components, join_sets, tree_edges


@dataclass(frozen=True)
class Graph:
    threshold: float = 0.93
    cell: int = 6000        # most vectors of a shard at home before it is split, and of a block of a pair
    fit_rows: int = 1024    # sample of a cell that its centres are fitted to
    ways: int = 8           # centres a cell is split around
    levels: int = 16        # most splits one after another
    degree: int = 24        # most neighbours of a node in a shard
    beam: int = 32          # candidates that a search keeps
    alpha: float = 1.2      # slack of the robust pruning
    batch: int = 512
    audit: int = 48         # linked vectors of each shard whose links are checked by brute force
    audit_rows: int = 1024  # most vectors of a shard that are compared with all others to find those
    recall: float = 0.98    # what the audit asks for, else the beam doubles and then all pairs are compared


# ---- one shard, in numpy -------------------------------------------------------------------

def beam_search(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes and cosines found for each query, best first (-1 pads); all queries walk the graph together, from the
    starts nearest to them."""
    q = x[queries]
    nodes = np.full((len(q), beam), -1, np.int64)
    sims = np.full((len(q), beam), -np.inf)
    done = np.ones((len(q), beam), bool)
    from_starts = q @ x[starts].T
    first = np.argsort(-from_starts, axis=1, kind="stable")[:, :beam]
    k = first.shape[1]
    nodes[:, :k], sims[:, :k], done[:, :k] = starts[first], np.take_along_axis(from_starts, first, 1), False
    rows = np.arange(len(q))
    while len(rows):
        best = np.argmax(np.where(done[rows], -np.inf, sims[rows]), axis=1)
        done[rows, best] = True
        near = adj[nodes[rows, best]]
        known = (near[:, :, None] == nodes[rows][:, None, :]).any(axis=2) | (near < 0)
        s = np.einsum("ij,ikj->ik", q[rows], x[np.maximum(near, 0)])
        s[known] = -np.inf
        all_nodes = np.concatenate([nodes[rows], np.where(known, -1, near)], axis=1)
        all_sims = np.concatenate([sims[rows], s], axis=1)
        all_done = np.concatenate([done[rows], known], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        nodes[rows], sims[rows] = np.take_along_axis(all_nodes, top, 1), np.take_along_axis(all_sims, top, 1)
        done[rows] = np.take_along_axis(all_done, top, 1) | (nodes[rows] < 0)
        rows = rows[~done[rows].all(axis=1)]
    return nodes, sims


def robust_prune(x: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates (-1 pads): the nearest is kept and drops those that are
    ``alpha`` times nearer to it than to the point, and so on."""
    cands = np.sort(cands, axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    alive = (cands >= 0) & (cands != points[:, None])
    vectors = x[np.maximum(cands, 0)]
    dist = np.maximum(2 - 2 * np.einsum("ij,ikj->ik", x[points], vectors), 0)
    between = np.maximum(2 - 2 * np.einsum("ikj,ilj->ikl", vectors, vectors), 0)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        best = np.argmin(np.where(alive, dist, np.inf), axis=1)
        has = alive[rows, best]
        if not has.any():
            break
        out[has, k] = cands[rows, best][has]
        alive &= ~has[:, None] | (alpha * alpha * between[rows, best] > dist)
        alive[rows, best] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def build(x: np.ndarray, how: Graph) -> np.ndarray:
    """Adjacency (-1 pads) of the flat graph over unit vectors."""
    n = len(x)
    rng = np.random.default_rng(n)
    adj = rng.integers(0, n, (n, how.degree))
    adj[:, how.degree // 2:] = -1
    starts, order = np.array([medoid(x)]), rng.permutation(n)
    for at in range(0, n, how.batch):
        points = order[at:at + how.batch]
        found, _ = beam_search(x, adj, starts, points, how.beam)
        adj[points] = robust_prune(x, points, np.concatenate([found, adj[points]], axis=1), how.degree, how.alpha)
        src = np.repeat(points, how.degree)
        dst = adj[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order_by = np.argsort(dst, kind="stable")
        src, dst = src[order_by], dst[order_by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), how.batch):  # reverse edges, pruned where a node has too many
            some = slice(lo, lo + how.batch)
            extra = np.full((len(nodes[some]), int(count[some].max())), -1, np.int64)
            for row, (f, c) in enumerate(zip(first[some], count[some])):
                extra[row, :c] = src[f:f + c]
            extra = extra[:, :4 * how.degree]  # a batch's later hubs are reached through earlier ones
            adj[nodes[some]] = robust_prune(x, nodes[some], np.concatenate([adj[nodes[some]], extra], axis=1), how.degree, how.alpha)
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, how: Graph, beam: int, starts: np.ndarray) -> np.ndarray:
    """Boolean matrix of the links found, in both directions: a beam search from the starts, then neighbours of
    everything in range, along edges of either direction, are looked at until nothing new is in range."""
    n = len(x)
    src, dst = np.nonzero(adj >= 0)[0], adj[adj >= 0]
    key = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    edges, first = key % n, np.searchsorted(key, np.arange(n + 1) * n)
    linked, looked = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for at in range(0, n, how.batch):
        queries = np.arange(at, min(at + how.batch, n))
        nodes, sims = beam_search(x, adj, starts, queries, beam)
        row, col = np.nonzero((nodes >= 0) & (sims >= how.threshold))
        a, b = queries[row], nodes[row, col]
        a, b = np.concatenate([a, queries]), np.concatenate([b, queries])  # a query's own neighbours are looked at too
        looked[a, b] = True
        while len(a):
            linked[a, b] = True
            found_a, found_b = [], []
            for lo in range(0, len(a), 65536):
                s = slice(lo, lo + 65536)
                count = first[b[s] + 1] - first[b[s]]
                near = edges[np.repeat(first[b[s]] - np.cumsum(count) + count, count) + np.arange(count.sum())]
                whose = np.repeat(a[s], count)
                new = ~looked[whose, near]
                key = np.unique(whose[new] * n + near[new])
                looked[key // n, key % n] = True
                found_a.append(key // n)
                found_b.append(key % n)
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            keep = np.zeros(len(a), bool)
            for lo in range(0, len(a), 65536):
                s = slice(lo, lo + 65536)
                keep[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= how.threshold
            a, b = a[keep], b[keep]
    np.fill_diagonal(linked, False)
    return linked | linked.T


def _unit(vectors) -> np.ndarray:  # noqa: ANN001
    """Double-precision unit vectors."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def audit_sample(x: np.ndarray, how: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that have links, found by brute force among a random ``audit_rows`` of the shard, and these links."""
    order = np.random.default_rng(len(x) + 1).permutation(len(x))[:how.audit_rows]
    rows, truth, size = [order[:0]], [np.zeros((0, len(x)), bool)], 4 * how.audit
    for at in range(0, len(order), size):
        some = order[at:at + size]
        links = x[some] @ x.T >= how.threshold
        links[np.arange(len(some)), some] = False
        rows.append(some[links.any(axis=1)])
        truth.append(links[links.any(axis=1)])
        if sum(map(len, rows)) >= how.audit:
            break
    return np.concatenate(rows), np.concatenate(truth)


def audited_links(x: np.ndarray, adj: np.ndarray, how: Graph, starts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Links and their recall on the audit sample (nan: no vector looked at has a link); the beam doubles until the recall is
    good, up to eight times its width, then all pairs are compared."""
    beam = how.beam
    starts = np.array([medoid(x)]) if starts is None else starts
    sample, truth = audit_sample(x, how)
    while True:
        links = range_search(x, adj, how, min(beam, max(len(x), 1)), starts)
        recall = float((links[sample] & truth).sum() / truth.sum()) if len(sample) else np.nan
        if not recall < how.recall:
            return links, recall
        if beam >= min(len(x), 8 * how.beam):
            return all_links(x, how), 1.0
        beam *= 2


def all_links(x: np.ndarray, how: Graph) -> np.ndarray:
    """The links of all pairs, by blocks of rows."""
    links = np.zeros((len(x), len(x)), bool)
    for at in range(0, len(x), how.batch):
        links[at:at + how.batch] = x[at:at + how.batch] @ x.T >= how.threshold
    np.fill_diagonal(links, False)
    return links | links.T


# ---- shards ----------------------------------------------------------------------------------

def _centres(how: Graph):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = _unit(part["emb"])
        rng = np.random.default_rng(len(x))
        centres = x[rng.permutation(len(x))[:how.ways]]
        for _ in range(10):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.stack([x[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "centres": [centres.ravel().tolist()]})
    return run


def _sides(how: Graph):
    reach = np.sqrt(max(0.0, 2 - 2 * how.threshold))  # distance of unit vectors in range

    def run(emb: pd.Series, centres: pd.Series) -> pd.Series:
        out = []
        for v, c in zip(emb, centres):
            x = _unit([v])[0]
            c = np.asarray(c).reshape(-1, len(x))
            sims = c @ x
            apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
            near = (sims[:, None] - sims[None, :] <= reach * apart + 1e-9).all(axis=0)
            out.append([int(k) for k in np.argsort(-sims, kind="stable") if near[k]])
        return pd.Series(out)
    return run


def overlapping_cells(nodes: DataFrame, how: Graph) -> DataFrame:
    """node, emb, times, cell, home: the shards each node is a member of; ``home`` marks one of them. A cell that
    a split would leave in large part on most sides stays whole."""
    columns = ["node", "emb", "times", "cell", "home", "whole"]
    members = materialize(nodes.select("node", "emb", "times", F.col("space").alias("cell"), F.lit(True).alias("home"),
                                       F.lit(False).alias("whole")), "cells")
    for _ in range(how.levels):
        sizes = members.where(~F.col("whole")).groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        large = materialize(sizes.where(F.col("homes") > how.cell), "large-cells")
        if not large.limit(1).count():
            break
        every = F.greatest(F.lit(1), F.floor(F.col("homes") / how.fit_rows))
        tagged = lookup_join(members, large, "cell", "n")
        sample = tagged.where(F.col("home") & F.col("n").isNotNull() & (F.pmod(F.xxhash64("node", "cell"), every) == 0)).select("cell", "emb")
        centres = sample.groupBy("cell").applyInPandas(_centres(how), "cell string, centres array<double>")
        centres = materialize(centres.join(large.select("cell", "n"), "cell"), "centres")
        sides = F.pandas_udf(_sides(how), "array<int>")("emb", "centres")
        split = lookup_join(members, centres, "cell", "n")
        whole = split.where(F.col("centres").isNull()).select(*columns)
        listed = materialize(split.where(F.col("centres").isNotNull()).select(*columns, sides.alias("sides")), "sides")
        held = listed.groupBy("cell").agg(F.avg(F.size("sides")).alias("held"), F.count("*").alias("n"))
        listed = lookup_join(listed, materialize(held, "held"), "cell", "n")
        stuck = F.col("held") > how.ways / 2
        parts = (listed.where(~stuck).select("node", "emb", "times", "cell", "home", F.posexplode("sides").alias("nth", "side"))
                 .select("node", "emb", "times", F.concat_ws("/", "cell", "side").alias("cell"),
                         (F.col("home") & (F.col("nth") == 0)).alias("home"), F.lit(False).alias("whole")))
        stuck_ones = listed.where(stuck).select("node", "emb", "times", "cell", "home", F.lit(True).alias("whole"))
        members = materialize(whole.unionByName(parts).unionByName(stuck_ones), "cells")
    return members.drop("whole")


FOUND = "node long, other long, links long, recall double"


def _found(home: np.ndarray, links: np.ndarray, recall: float, child: np.ndarray, above: np.ndarray) -> pd.DataFrame:
    return pd.concat([
        pd.DataFrame({"node": home, "other": None, "links": links.astype(np.int64), "recall": recall}),
        pd.DataFrame({"node": child, "other": above, "links": None, "recall": None})]).astype(
            {"other": "Int64", "links": "Int64", "recall": "Float64"})


BUILT = "cell string, node long, near array<long>, medoid boolean"


def _build_cell(how: Graph):
    """The adjacency lists of a shard's graph, and its medoid."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node"], kind="stable").reset_index(drop=True)
        ids, x = part["node"].to_numpy(), _unit(part["emb"])
        adj = build(x, how)
        return pd.DataFrame({"cell": part["cell"], "node": ids, "near": [ids[a[a >= 0]] for a in adj], "medoid": np.arange(len(ids)) == medoid(x)})
    return run


def _adjacency(ids: np.ndarray, near) -> np.ndarray:  # noqa: ANN001
    """Rows of members' positions (-1 pads) from lists of nodes; those that are no members are left out."""
    src = np.repeat(np.arange(len(ids)), [len(v) for v in near])
    dst = np.concatenate([np.asarray(v, np.int64) for v in near])
    at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    here = ids[at] == dst
    src, at = src[here], at[here]
    count = np.bincount(src, minlength=len(ids))
    adj = np.full((len(ids), max(1, count.max(initial=0))), -1, np.int64)
    adj[src, np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)] = at
    return adj


def _search_cell(how: Graph):
    """The links that the members of a shard have in the united graph."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node"], kind="stable").reset_index(drop=True)
        ids, x = part["node"].to_numpy(), _unit(part["emb"])
        links, recall = audited_links(x, _adjacency(ids, part["near"]), how, np.union1d(medoid(x), np.nonzero(part["medoid"].to_numpy())[0]))
        a, b = np.nonzero(np.triu(links))
        child, above = tree_edges(join_sets(np.arange(len(ids)), a, b))
        counts = links @ part["times"].to_numpy().astype(np.float64)
        home = part["home"].to_numpy()
        return _found(ids[home], counts[home], recall, ids[child], ids[above])
    return run


def _compare_blocks(how: Graph):
    """All pairs of a block of a cell's vectors at home and a block of its members."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy()
        ids = np.unique(part["node"].to_numpy())
        node = part["node"].to_numpy()
        at, to = np.searchsorted(ids, node[asks]), np.searchsorted(ids, node[~asks])
        if not len(at) or not len(to):
            return _found(node[asks], np.zeros(len(at)), 1.0, node[:0], node[:0])
        x = _unit(part["emb"])
        q, y, times = x[asks], x[~asks], part["times"].to_numpy()[~asks].astype(np.float64)
        counts, sets = np.zeros(len(q)), np.arange(len(ids))
        for lo in range(0, len(q), how.batch):
            s = slice(lo, lo + how.batch)
            links = (q[s] @ y.T >= how.threshold) & (at[s][:, None] != to[None, :])
            counts[s] = links @ times
            row, col = np.nonzero(links)
            sets = join_sets(sets, at[s][row], to[col])
        child, above = tree_edges(sets)
        return _found(ids[at], counts, 1.0, ids[child], ids[above])
    return run


def linked_nodes(nodes: DataFrame, how: Graph) -> DataFrame:
    """Per node its weighted links and the audited recall of its shard (other null); and tree edges (other set)."""
    members = overlapping_cells(nodes, how)
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    members = lookup_join(members, materialize(sizes, "cell-sizes"), "cell", "n").where(F.col("homes") > 0)
    small = members.where(F.col("n") <= how.cell)
    built = materialize(small.groupBy("cell").applyInPandas(_build_cell(how), BUILT), "shard-graphs")
    # a node has a list in each shard that it is a member of, so it has few
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    searched = small.join(united, "node").groupBy("cell").applyInPandas(_search_cell(how), FOUND)
    blocks = lambda n: F.ceil(F.col(n) / how.cell).cast("int")
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    large = members.where(F.col("n") > how.cell)
    pairs = (large.where("home").select("node", "emb", "times", "cell", F.lit(True).alias("asks"), block(1, "homes").alias("i"), every("n").alias("j"))
             .unionByName(large.select("node", "emb", "times", "cell", F.lit(False).alias("asks"), every("homes").alias("i"), block(2, "n").alias("j"))))
    found = searched.unionByName(pairs.groupBy("cell", "i", "j").applyInPandas(_compare_blocks(how), FOUND))
    return found.groupBy("node", "other").agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))


def near_duplicates(vectors: DataFrame, how: Graph = Graph(), id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per vector: ``id_col``, n_links (other vectors linked directly), component_id (the smallest id reachable),
    kept (the id is component_id), recall (audited, of its shard; null where no vector that was looked at has a link).

    Linked are vectors of one label and dimension with a cosine of at least ``how.threshold``.

    Defined cases: null, empty, zero vectors, those with null or non-finite parts and those of a null label link with
    nothing and are their own component; copies are linked with each other; null ids count as vectors, and a
    component of null ids alone has a null component_id and kept true; an empty table gives an empty
    result; other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    v = F.col("emb")
    sound = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    fit = (v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, sound) & F.exists(v, lambda e: e != 0))
    space = F.concat_ws(":", F.col("label").cast("string"), F.size(v))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("emb"))
            .withColumn("space", F.when(F.coalesce(fit, F.lit(False)), space))
            .withColumn("same", F.when(F.col("space").isNotNull(), F.concat_ws(
                "/", "space", F.xxhash64("emb"), F.xxhash64(F.lit(1), "emb")))))  # two hashes: one node for copies
    rows = materialize(rows.select("id", "space", "same", "emb"), "vectors")
    nodes = materialize(rows.where(F.col("same").isNotNull()).groupBy("same")
                        .agg(F.first("space").alias("space"), F.first("emb").alias("emb"), F.count("*").alias("times"), F.min("id").alias("least"))
                        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = materialize(linked_nodes(nodes, how), "links")
    classes = connected_components(found.where(F.col("other").isNotNull()), "node", "other")
    nodes = (nodes.select("same", "times", "least", "node").join(found.where(F.col("other").isNull()).select("node", "links", "recall"), "node")
             .join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")))
    nodes = materialize(nodes, "linked-nodes")
    heads = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("held"))
    nodes = lookup_join(nodes.select("same", "times", "links", "recall", "component"), heads, "component", "held")
    out = lookup_join(rows.select("id", "same"), nodes.select("same", "times", "links", "recall", "component_id"), "same", "times")
    alone = F.col("same").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("times") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("id").eqNullSafe(F.when(alone, F.col("id")).otherwise(F.col("component_id"))).alias("kept"), "recall")
