"""Packing token sequences into fixed windows by bulk-synchronous best-fit.

Documents are tokenised; longer ones are cut into full windows and one shorter first piece. A piece of more than half a
window opens a sequence of its own. The others are placed in rounds, from the long lengths to the short ones. Every round

1. range-sorts its pieces and the gaps of all open sequences together, longest first, a gap before a piece of its size;
2. sweeps each partition: a piece takes its successor, the smallest gap seen that still holds it, and what is left of the
   gap is met again where the sweep reaches its size;
3. resolves what no gap of the same partition holds by rank: partitions report how many pieces and gaps they have left,
   by size class, and the smallest gaps left in the partitions before are given to ranges of ranks. A range of a
   gap class takes as many pieces at a time as its smallest gap holds of the longest of them;
4. opens sequences for the pieces that no gap is left for, filled by runs of ranks; and
5. updates the gaps, which are the next round's.

The driver sees a row per partition and size class, never pieces or gaps.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probitas.llm.common import materialize, ship_package
from probitas.llm.tokenizing import ByteCoder, tokenizer_json

SHARES = (3, 4, 5, 6, 8, 12, 16, 32, 64)  # a round takes the pieces above window / share; the last round takes the rest
PLACED, LEFT, GAP, SPARE = 0, 1, 2, 3     # what a sweep says of a row; spare gaps came up after the last piece


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str,
                 with_ids: bool) -> DataFrame:
    """Tokenise and cut: one row per piece, numbered (``__uid``) by task and place."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    tail = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = None, TaskContext.get().partitionId() << 40
        for whole in batches:
            coder = coder or ByteCoder.of(model.value)
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                rows, numbers, starts, lengths, crcs, ids = [], [], [], [], [], []
                for k, text in enumerate(some.column(1)):
                    packed = coder.encode(text.as_py()) + tail
                    n = len(packed) // 4
                    start, number, length = 0, 0, n % window or window
                    while start < n:
                        piece = packed[4 * start:4 * (start + length)]
                        rows.append(k)
                        numbers.append(number)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        ids.append(piece if with_ids else None)
                        start, number, length = start + length, number + 1, window
                uids = list(range(uid, uid + len(rows)))
                uid += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(uids, pa.int64()), pa.array(ids, pa.binary())],
                    names=["__id", "piece", "start", "length", "ids_crc32", "__uid", "ids"])

    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .mapInArrow(cut, f"__id {id_type}, piece int, start long, length long, ids_crc32 long, __uid long, ids binary"))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best fit within one partition of the sorted rows (size, kind, key): see the module's text.

    The stack holds the gaps that the sweep has passed, smallest on top; what is left of a gap waits in ``later`` until
    the sweep comes down to its size.
    """
    part = TaskContext.get().partitionId()
    stack: list[tuple[int, int]] = []
    later: list[tuple[int, int]] = []
    left = 0

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else ([],) * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(out), pa.int32())],
                                          names=["state", "key", "size", "seq", "rank", "part"])

    for batch in batches:
        out = []
        for size, is_piece, key in zip(*(batch.column(k).to_pylist() for k in range(3))):
            while later and -later[0][0] >= size:
                gap, seq = heapq.heappop(later)
                stack.append((-gap, seq))
            if not is_piece:
                stack.append((size, key))
            elif not stack:
                out.append((LEFT, key, size, None, left))
                left += 1
            else:
                gap, seq = stack.pop()
                out.append((PLACED, key, size, seq, None))
                if gap - size >= size:
                    stack.append((gap - size, seq))
                elif gap > size:
                    heapq.heappush(later, (size - gap, seq))
        yield rows(out)
    for at in range(0, len(stack), 10_000):
        yield rows([(GAP, seq, gap, None, at + k) for k, (gap, seq) in enumerate(stack[at:at + 10_000])])
    for at in range(0, len(later), 10_000):
        yield rows([(SPARE, seq, -gap, None, None) for gap, seq in later[at:at + 10_000]])


def size_class(window: int):
    """How often a size fits into the window, in powers of two from 64 on: a class spans a narrow range of sizes."""
    times = F.floor(F.lit(window) / F.col("size"))
    return F.when(times < 64, times).otherwise(F.floor(F.log2(times.cast("double"))) + 58)


def deal(segments: list, window: int, opened: int) -> tuple[list[tuple], int]:
    """Which ranks of pieces left over go where: rows (part, a, b, each, to_part, at, step), and the sequences opened so far.

    Piece of rank i in [a, b) goes to gap ``at + step * floor((i - a) / each)`` of ``to_part``; part -1 stands for new
    sequences. ``segments`` are (part, state, class, first rank, end rank, smallest, largest) of LEFT and GAP rows.
    """
    rows, stack = [], []
    parts: dict[int, tuple[list, list]] = {}
    for part, state, _, a, b, small, large in segments:
        parts.setdefault(part, ([], []))[state == GAP].append((a, b, small, large))
    for part in sorted(parts):
        pieces, gaps = map(sorted, parts[part])
        for a, b, _, longest in pieces:
            while a < b and stack:
                where, first, end, smallest = stack.pop()
                each = smallest // longest
                gaps_taken = min(-(-(b - a) // each), end - first)
                to = min(b, a + gaps_taken * each)
                rows.append((part, a, to, each, where, end - 1, -1))
                a = to
                if end - gaps_taken > first:
                    stack.append((where, first, end - gaps_taken, smallest))
            if a < b:
                each = window // longest
                rows.append((part, a, b, each, -1, opened, 1))
                opened += -(-(b - a) // each)
        stack += [(part, a, b, small) for a, b, small, _ in gaps]
    return rows, opened


def place(pieces: DataFrame, window: int) -> DataFrame:
    """(uid, size, seq) of all pieces shorter than the window; ``pieces`` has uid and size and has been written."""
    spark = pieces.sparkSession
    half = window // 2
    short = pieces.where(F.col("size") < window)
    openers = short.where(F.col("size") > half)
    gaps = openers.select((window - F.col("size")).alias("size"), F.lit(0).alias("kind"), F.col("uid").alias("key"))
    limits = [half, *sorted({window // s for s in SHARES if window // s < half}, reverse=True), 0]
    turn = reduce(lambda other, k: F.when(F.col("size") > limits[k + 1], k).otherwise(other),
                  reversed(range(len(limits) - 1)), F.lit(None).cast("int"))
    turns = sorted(r["turn"] for r in short.where(F.col("size") <= half).select(turn.alias("turn")).distinct().collect())  # a row per round

    placed = [openers.select("uid", "size", F.col("uid").alias("seq"))]
    dealt, holders, opened = [], [], 0
    for k in turns:
        now = short.where((F.col("size") <= limits[k]) & (F.col("size") > limits[k + 1]))
        both = gaps.unionByName(now.select("size", F.lit(1).alias("kind"), F.col("uid").alias("key")))
        order = [F.col("size").desc(), F.col("kind"), F.col("key")]
        swept = materialize(both.repartitionByRange(*order).sortWithinPartitions(*order).select("size", "kind", "key")
                            .mapInArrow(sweep, "state int, key long, size long, seq long, rank long, part int"), f"best-fit-{k}")
        # a row per partition and size class
        segments = (swept.where(F.col("state").isin(LEFT, GAP)).withColumn("class", size_class(window))
                    .groupBy("part", "state", "class").agg(F.min("rank"), F.max("rank") + 1, F.min("size"), F.max("size")).collect())
        rows, opened = deal([tuple(s) for s in segments], window, opened)
        plan = spark.createDataFrame(rows, "part int, a long, b long, each long, to_part int, at long, step int")
        # The plan has about a row per partition and class, so it is broadcast.
        moved = (swept.where(F.col("state") == LEFT).alias("x")
                 .join(F.broadcast(plan).alias("p"), (F.col("x.part") == F.col("p.part")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
                 .select(F.lit(k).alias("round"), F.col("to_part").alias("part"),
                         (F.col("at") + F.col("step") * F.floor((F.col("rank") - F.col("a")) / F.col("each"))).alias("rank"),
                         F.col("key").alias("uid"), "size"))
        held = swept.where(F.col("state") == GAP).select(F.lit(k).alias("round"), "part", "rank", F.col("key").alias("seq"), "size")
        placed += [swept.where(F.col("state") == PLACED).select(F.col("key").alias("uid"), "size", "seq"),
                   moved.where("part = -1").select("uid", "size", (-1 - F.col("rank")).alias("seq"))]
        dealt.append(moved.where("part >= 0"))
        holders.append(held)
        room = F.sum(F.when(F.col("seq").isNull(), -F.col("size")).otherwise(F.col("size"))) + F.when(F.col("part") == -1, window).otherwise(0)
        updated = (held.select("part", "rank", "seq", "size")
                   .unionByName(moved.select("part", "rank", F.lit(None).cast("long").alias("seq"), "size"))
                   .groupBy("part", "rank").agg(room.alias("size"), F.coalesce(F.max("seq"), -1 - F.col("rank")).alias("key"))
                   .where("size > 0"))
        gaps = (updated.select("size", F.lit(0).alias("kind"), "key")
                .unionByName(swept.where(F.col("state") == SPARE).select("size", F.lit(0).alias("kind"), "key")))
    if dealt:
        placed.append(reduce(DataFrame.unionByName, dealt)
                      .join(reduce(DataFrame.unionByName, holders).drop("size"), ["round", "part", "rank"]).select("uid", "size", "seq"))
    return reduce(DataFrame.unionByName, placed)


def pack_best_fit(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids
    (packed little-endian 32-bit numbers).

    A document is its text's ids and ``end_id``. Only documents longer than ``window`` are cut, into windows behind a
    first piece that may be shorter. Pieces of one sequence lie end to end from offset 0, longest first, and
    sum to at most ``window``; which equal pieces share a sequence depends on the partitions, the result is valid for any.

    Defined cases: a null or empty text has ``end_id`` alone; null and repeated ids are packed row by row; a text of
    any length is cut into windows; pieces of equal length go by the place where they were read; an empty table gives an
    empty result; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col, with_ids), "best-fit-pieces")
    placed = place(pieces.select(F.col("__uid").alias("uid"), F.col("length").alias("size")), window)
    before = Window.partitionBy("seq").orderBy(F.col("size").desc(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("uid").alias("__uid"), F.col("seq").alias("__seq"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__off"))
    out = (pieces.join(placed, "__uid", "left")  # pieces of a whole window have a sequence of their own
           .select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32",
                   F.coalesce("__seq", "__uid").alias("sequence_id"), F.coalesce("__off", F.lit(0)).alias("offset"), "ids"))
    return out if with_ids else out.drop("ids")
