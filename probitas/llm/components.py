"""Connected components of a graph given as an edge table, with nothing collected to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas.llm.common import lookup_join, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reachable) for every node of a table of long edges.

    Each round takes the smallest label among a node and its neighbours, then the label of that label;
    rounds are written tables, so a lost executor repeats one round at most. Counts per key are
    pre-aggregated, and the jump to the label's label is a lookup that no hot label can skew.
    """
    both = materialize(
        edges.select(F.col(src).alias("node"), F.col(dst).alias("other"))
        .unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other")))
        .where("node <> other").distinct(), "edges")
    state = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    state = materialize(state.withColumn("moved", F.lit(True)), "labels")
    while state.where("moved").limit(1).count():
        near = both.join(state.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
        best = (near.unionByName(state.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")))
        best = materialize(best, "labels")
        held = best.groupBy(F.col("label").alias("at")).agg(F.count("*").alias("held"))
        targets = held.join(best.select(F.col("node").alias("at"), F.col("label").alias("next")), "at")
        jumped = lookup_join(best.withColumnRenamed("label", "at"), targets, "at", "held")
        jumped = jumped.select("node", F.least("at", "next").alias("label"))
        old = state.select("node", F.col("label").alias("old"))
        state = materialize(jumped.join(old, "node").select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
    return state.select("node", F.col("label").alias("component"))


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a[i] and b[i]; ``parent`` maps every index to the smallest index of its set."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tree_edges(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices that connect every set: a balanced tree over its members, so that no member gets more
    than three edges and the tree stays shallow."""
    order = np.argsort(parent, kind="stable")
    sets, first, size = np.unique(parent[order], return_index=True, return_counts=True)
    nth = np.arange(len(parent)) - np.repeat(first, size)
    child = np.flatnonzero(nth > 0)
    above = child - nth[child] + (nth[child] - 1) // 2
    return order[child], order[above]
