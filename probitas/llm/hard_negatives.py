"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of its own label. Every positive opens a window of scores in which negatives are
hard, and the windows of one anchor overlap. Their upper limits cut the scores into disjoint slots: the negatives of
slot j lie above the limit of positive j + 1 and not above that of positive j. Each task keeps the top k of every
slot for its rows, combiners keep the top k of those, and merging the slots from the lowest upwards, k at a time, gives
the top k at or below every upper limit: all windows are answered from at most k rows a slot.

Scores come from products of packed cells: a tile of row cells meets a tile of anchor cells in one cogroup, so that
anchors, which grow with the input, are never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.llm.common import materialize, ship_package

CELL_BYTES, CELL_ROWS = 1_000_000, 8192  # of one packed cell
TILE_CELLS = 8                           # cells of a tile, about
ANCHORS_AT_ONCE = 256                    # rows of a matrix of scores
NONE = np.iinfo(np.int64).min            # no score
CELLS = "cell long, width int, ids binary, labels binary, vectors binary"


def pack_cells(scale: float):
    """Rows (id, label, vector) as cells of quantised vectors, cut by rows and bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = TaskContext.get().partitionId() << 20
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                width = max(1, max(len(v) for v in whole.column(2).slice(at, CELL_ROWS)))
                some = whole.slice(at, max(1, min(CELL_ROWS, CELL_BYTES // (4 * width))))
                at += some.num_rows
                vectors = some.column(2)
                lengths = np.diff(vectors.offsets.to_numpy())
                out = np.zeros((some.num_rows, width), "<i4")
                real = np.arange(width) < lengths[:, None]
                values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                out[real] = np.clip(values, -2 ** 31, 2 ** 31 - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell], pa.int64()), pa.array([width], pa.int32()),
                     *(pa.array([some.column(k).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for k in range(2)),
                     pa.array([out.tobytes()], pa.binary())], names=["cell", "width", "ids", "labels", "vectors"])
                cell += 1
    return run


def unpack_cells(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, vectors and keys (cell and place) of all rows of some cells, by label and id. Shorter vectors end in zeros."""
    width = int(cells.width.max())
    ids, labels, vectors, keys = [], [], [], []
    for c in cells.itertuples():
        ids.append(np.frombuffer(c.ids, "<i8"))
        labels.append(np.frombuffer(c.labels, "<i8"))
        own = np.frombuffer(c.vectors, "<i4").reshape(-1, c.width)
        vectors.append(np.pad(own, ((0, 0), (0, width - c.width))))
        keys.append((c.cell << 20) + np.arange(len(own)))
    ids, labels, vectors, keys = map(np.concatenate, (ids, labels, vectors, keys))
    order = np.lexsort((keys, ids, labels))
    return ids[order], labels[order], vectors[order], keys[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles, which matrix libraries are fast at, where no sum can pass 2 ** 53."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if len(a) == 0 or len(b) == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * width < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores, smaller ids first among equal ones; NONE is never taken."""
    n = scores.shape[1]
    if n == 0:
        return np.empty(0, int), np.empty(0, int)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    real = scores != NONE
    if np.abs(np.where(real, scores, 0)).max(initial=0) < 2 ** 62 // n:
        unique = np.where(real, scores * n + (n - 1 - rank), NONE)
        picked = np.argpartition(unique, n - k, axis=1)[:, n - k:] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    else:
        picked = order[np.argsort(-scores[:, order].astype(object), axis=1, kind="stable")[:, :k]]
    rows = np.repeat(np.arange(len(scores)), picked.shape[1])
    cols = picked.ravel()
    keep = real[rows, cols]
    return rows[keep], cols[keep]


def _blocks(labels: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal label, at most ANCHORS_AT_ONCE long."""
    values, first = np.unique(labels, return_index=True)
    for label, a, z in zip(values, first, [*first[1:], len(labels)]):
        for at in range(a, z, ANCHORS_AT_ONCE):
            yield label, slice(at, min(z, at + ANCHORS_AT_ONCE))


def _meet(rows: DataFrame, anchors: DataFrame, tiles: tuple[int, int], work, schema: str) -> DataFrame:  # noqa: ANN001
    """``work`` on every tile of row cells with every tile of anchor cells."""
    row_tiles, anchor_tiles = tiles
    left = (rows.withColumn("__r", F.pmod(F.xxhash64("cell"), F.lit(row_tiles)))
            .withColumn("__a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_tiles - 1).cast("long")))))
    right = (anchors.withColumn("__a", F.pmod(F.xxhash64("cell"), F.lit(anchor_tiles)))
             .withColumn("__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_tiles - 1).cast("long")))))
    return left.groupBy("__r", "__a").cogroup(right.groupBy("__r", "__a")).applyInPandas(work, schema)


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(names)
    return pd.DataFrame(dict(zip(names, columns)))


def best_positives(rows: DataFrame, anchors: DataFrame, tiles: tuple[int, int], n_positives: int) -> DataFrame:
    """(akey, positives): every anchor's best rows of its label, best first."""
    def work(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(cells) and len(asked):
            ids, labels, vectors, _ = unpack_cells(cells)
            a_ids, a_labels, a_vectors, keys = unpack_cells(asked)
            for label, at in _blocks(a_labels):
                lo, hi = np.searchsorted(labels, [label, label + 1])
                scores = products(a_vectors[at], vectors[lo:hi])
                scores[a_ids[at][:, None] == ids[lo:hi]] = NONE
                i, j = top(scores, ids[lo:hi], n_positives)
                parts.append((keys[at][i], scores[i, j], ids[lo:hi][j]))
        return _frame(parts, ["akey", "score", "id"])

    found = _meet(rows, anchors, tiles, work, "akey long, score long, id long")
    nth = F.row_number().over(Window.partitionBy("akey").orderBy(F.col("score").desc(), "id"))
    best = found.withColumn("__nth", nth).where(F.col("__nth") <= n_positives)
    return (best.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("__nth", "score", "id"))).alias("p"))
            .select("akey", F.transform("p", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives")))


def with_limits(anchors: DataFrame, positives: DataFrame, n_positives: int, lower: tuple[int, int], upper: tuple[int, int]) -> DataFrame:
    """Anchor cells with the upper limits of their anchors' positives, best first, and the least lower limit behind them."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        limits = np.full((int(rows.place.max()) + 1, n_positives + 1), NONE, np.int64)
        for place, scores in zip(rows.place, rows.scores):
            limits[place, :len(scores)] = [s * upper[0] // upper[1] for s in scores.tolist()]
            limits[place, -1] = min(-(-s * lower[0] // lower[1]) for s in scores.tolist())
        return pd.DataFrame({"cell": [rows.cell.iloc[0]], "limits": [limits.tobytes()]})

    limits = (positives.select(F.shiftright("akey", 20).alias("cell"), F.col("akey").bitwiseAND(F.lit((1 << 20) - 1)).alias("place"),
                               F.col("positives.score").alias("scores"))
              .groupBy("cell").applyInPandas(pack, "cell long, limits binary"))
    return anchors.join(limits, "cell")  # a cell whose anchors all lack positives has no windows


def best_by_slot(rows: DataFrame, anchors: DataFrame, tiles: tuple[int, int], n_positives: int, k: int) -> DataFrame:
    """(akey, slots): the top k negatives of every slot of every anchor, as (slot, score downwards, id)."""
    def work(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(cells) and len(asked):
            ids, labels, vectors, _ = unpack_cells(cells)
            a_ids, a_labels, a_vectors, keys = unpack_cells(asked)
            by_key = {}
            for c in asked.itertuples():
                limits = np.frombuffer(c.limits, "<i8").reshape(-1, n_positives + 1)
                by_key |= {(c.cell << 20) + place: own for place, own in enumerate(limits)}
            absent = np.full(n_positives + 1, NONE)
            limits = np.array([by_key.get(x, absent) for x in keys.tolist()])
            for label, at in _blocks(a_labels):
                lo, hi = np.searchsorted(labels, [label, label + 1])
                scores, own = products(a_vectors[at], vectors), limits[at]
                hard = scores >= own[:, -1:]  # below every window
                hard[:, lo:hi] = False
                hard[a_ids[at][:, None] == ids] = False
                for slot in range(n_positives):
                    under = own[:, slot + 1:slot + 2] if slot + 1 < n_positives else np.full((len(own), 1), NONE)
                    held = hard & (scores <= own[:, slot:slot + 1]) & (scores > under)
                    i, j = top(np.where(held, scores, NONE), ids, k)
                    parts.append((keys[at][i], np.full(len(i), slot), scores[i, j], ids[j]))
        return _frame(parts, ["akey", "slot", "score", "id"])

    found = _meet(rows, anchors, tiles, work, "akey long, slot long, score long, id long")
    nth = F.row_number().over(Window.partitionBy("akey", "slot").orderBy(F.col("score").desc(), "id"))
    return (found.withColumn("__nth", nth).where(F.col("__nth") <= k)
            .groupBy("akey").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")).alias("slots")))


def suffix_merges(positives: Column, slots: Column, k: int) -> Column:
    """For every positive the top k of its slot and all lower ones, as (down, id)."""
    kind = "array<struct<down:bigint,id:bigint>>"

    def merge(done: Column, j: Column) -> Column:
        own = F.transform(F.filter(slots, lambda x: x["slot"] == j), lambda x: F.struct(x["down"].alias("down"), x["id"].alias("id")))
        lower = F.coalesce(F.get(done, F.lit(0)), F.array().cast(kind))
        return F.concat(F.array(F.slice(F.array_sort(F.concat(lower, own)), 1, k)), done)

    return F.aggregate(F.sequence(F.size(positives) - 1, F.lit(0), F.lit(-1)), F.array().cast(f"array<{kind}>"), merge)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 3, lower: tuple[int, int] = (50, 100),
                        upper: tuple[int, int] = (95, 100), scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.

    Components become floor(scale * x); a row's score is its inner product with the anchor. An anchor's positives are
    its best ``n_positives`` other rows of the same label; a positive's negatives are the best ``k`` rows of other labels
    with lower[0] * positive_score <= lower[1] * score and upper[1] * score <= upper[0] * positive_score. Higher scores come first,
    equal ones by smaller id.

    Defined cases: rows with a null id, label or vector or a null, NaN or infinite component take no part; labels and ids are
    whole numbers; an empty vector scores 0 with all; of vectors of different lengths the common part counts; components
    beyond 2 ** 31 after scaling count as that, and scores must fit in 64 bits; a row with the anchor's id is the anchor
    itself, other repeated rows count as often as they occur; an anchor without positives, or a positive without negatives, has no
    row; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    ship_package(spark)
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(~odd)
    plain = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.cast("array<double>").alias("vector")]
    cells = materialize(valid.select(*plain).mapInArrow(pack_cells(scale), CELLS), "negatives-rows")
    anchors = materialize(valid.where(is_anchor).select(*plain).mapInArrow(pack_cells(scale), CELLS), "negatives-anchors")
    n_cells, n_asked = cells.count(), anchors.count()
    # Tiles of about TILE_CELLS cells, and as many of rows as keep all cores busy.
    tiles = max(1, -(-n_cells // TILE_CELLS), min(n_cells, 4 * spark.sparkContext.defaultParallelism)), max(1, -(-n_asked // TILE_CELLS))

    positives = materialize(best_positives(cells, anchors, tiles, n_positives), "negatives-positives")
    limited = materialize(with_limits(anchors, positives, n_positives, lower, upper), "negatives-limits")
    slots = best_by_slot(cells, limited, tiles, n_positives, k)
    named = anchors.select("cell", "ids").mapInArrow(_names, "akey long, anchor_id long")

    pair = F.transform(F.col("windows"), lambda w, j: F.struct(
        F.get("positives", j).alias("positive"),
        F.filter(w, lambda n: F.lit(lower[0]) * F.get("positives", j)["score"] <= -F.lit(lower[1]) * n["down"]).alias("negatives")))
    return (positives.join(slots, "akey").join(named, "akey")
            .withColumn("windows", suffix_merges(F.col("positives"), F.col("slots"), k))
            .select("anchor_id", F.explode(pair).alias("w"))
            .select("anchor_id", "w.positive", F.posexplode("w.negatives").alias("nth", "negative"))
            .select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("nth") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
                    F.col("positive.score").alias("positive_score"), (-F.col("negative.down")).alias("negative_score")))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array((cell << 20) + np.arange(len(own))), pa.array(own)], names=["akey", "anchor_id"])
