"""Packing token sequences into fixed windows by minimum bin slack.

Documents are tokenised and cut into full windows and one remainder. The remainders' lengths form a
histogram of at most ``window`` numbers however many documents there are, and only that is planned
on the driver: each pattern starts with the longest remainder left, a bitset subset-sum picks the multiset
of remaining lengths that fills the window closest to its capacity, backtracking gives the counts per length, and
the pattern is used as often as the counts allow. The plan (intervals of ranks per length) is joined back to the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probitas.llm.common import materialize, ship_package
from probitas.llm.tokenizing import WordMemo, tokenizer_json

DOCS_AT_ONCE = 256  # documents tokenised together within a task


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Counts per length of the multiset whose sum comes closest to ``room`` without passing it.

    Bit s of ``reach`` says whether the lengths so far can sum to s. Longer lengths go first and counts are split
    into powers of two; the steps are kept and walked back from the best sum.
    """
    reach, keep, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            n = min(take, left)
            grown = (reach | reach << (n * length)) & keep
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            left, take = left - n, take * 2
        if reach >> room & 1:
            break
    best, picked = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:  # this step was needed to get here
            picked[length] = picked.get(length, 0) + n
            best -= n * length
    return picked


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, counts per length) patterns that use up the histogram of lengths 1 to ``window``.

    A pattern is repeated until one of its lengths runs short; there are at most about
    window * log(window) patterns whatever the counts are.
    """
    left, patterns = dict(histogram), []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill(window - longest, left)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        patterns.append((times, used))
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return patterns


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str,
                 with_ids: bool) -> DataFrame:
    """Tokenise and cut: one row per piece, with its task and its rank among the task's pieces of that length."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    tail = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, part = None, {}, TaskContext.get().partitionId()
        for batch in batches:
            memo = memo or WordMemo.of(model.value)
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                rows, starts, lengths, crcs, totals, ranks, ids = [], [], [], [], [], [], []
                for k, packed in enumerate(memo.encode(some.column(1).to_pylist())):
                    packed += tail
                    n = len(packed) // 4
                    for start in range(0, n, window):
                        piece = packed[4 * start:4 * (start + window)]
                        length = len(piece) // 4
                        rows.append(k)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                        ranks.append(seen.get(length, 0))
                        seen[length] = ranks[-1] + 1
                        ids.append(piece if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array([part] * len(rows), pa.int32()),
                     pa.array(ranks, pa.int64()), pa.array(ids, pa.binary())],
                    names=["__id", "start", "length", "ids_crc32", "doc_tokens", "__part", "__rank", "ids"])

    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .mapInArrow(cut, f"__id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, __part int, __rank long, ids binary"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, ids (packed little-endian 32-bit numbers).

    Pieces of one sequence lie end to end from offset 0 and sum to at most ``window``.

    Defined cases: a null or empty text has ``end_id`` alone; null and repeated ids are packed row by row; a text of
    any length is cut into windows; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= window rows

    # Each pattern's lengths, longest first, take the next ranks of their length.
    intervals, next_rank, sequence = [], {}, 0
    for times, used in plan(histogram, window):
        offset = 0
        for length in sorted(used, reverse=True):
            a = next_rank.get(length, 0)
            next_rank[length] = a + times * used[length]
            intervals.append((length, a, next_rank[length], used[length], sequence, offset))
            offset += length * used[length]
        sequence += times
    plan_df = spark.createDataFrame(intervals, "length long, __a long, __b long, __each long, __seq long, __off long")
    nth = F.col("__rank") + F.col("__first")
    step = F.col("__nth") - F.col("__a")
    placed = pieces.join(firsts, ["__part", "length"]).withColumn("__nth", nth)
    # The plan's size depends on the window alone, so it is broadcast.
    out = (placed.alias("p").join(F.broadcast(plan_df).alias("q"), (F.col("p.length") == F.col("q.length"))
                                  & (F.col("__nth") >= F.col("__a")) & (F.col("__nth") < F.col("__b")))
           .select(F.col("__id").alias(id_col), "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
                   (F.col("__seq") + F.floor(step / F.col("__each"))).alias("sequence_id"),
                   (F.col("__off") + F.pmod(step, F.col("__each")) * F.col("p.length")).alias("offset"), "ids"))
    return out if with_ids else out.drop("ids")
