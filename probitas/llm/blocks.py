"""Blocks of rows: how numpy stages exchange arrays and compressed texts through tables.

A task cuts its rows into blocks that carry the task's number. The blocks are written once, with their number, ids and
compressed texts, and every stage reads that table: what belongs to a block does not depend on how files are split when they
are read again, so a stage can send a block what it needs by its number instead of moving texts about.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

BLOCK_ROWS, BLOCK_BYTES = 1024, 4_000_000  # documents of a block
NULL_ID = np.iinfo(np.int64).max           # null ids come after all others
SHIPPED = "block long, ids binary, sizes binary, texts binary, others binary"


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Columns of equal length as one value of a table's cell, byte plane by byte plane: the high bytes of small
    numbers then lie together, where the shuffle's compression takes them away."""
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays.values())
    return b"".join(planes)


def unpack(blob: bytes, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds.values())
    out, at = {}, 0
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)
        at += n * size
    return out


def gather(blobs, kinds: dict[str, str]) -> dict[str, np.ndarray]:  # noqa: ANN001
    width = sum(np.dtype(k).itemsize for k in kinds.values())
    out, at = {name: np.empty(sum(map(len, blobs)) // width, kind) for name, kind in kinds.items()}, 0
    for b in blobs:  # one after the other: all of them unpacked beside the whole would take twice the memory
        for name, values in unpack(b, kinds).items():
            out[name][at:at + len(values)] = values
        at += len(b) // width
    return out


def give_back() -> None:
    """What freed arrays have left with the allocators goes back to the system: a worker lives on through later stages, and
    counts with its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def by_key(key: np.ndarray, arrays: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The columns cut up by key, rows in order."""
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    for k, at, to in zip(values.tolist(), first, [*first[1:], len(order)]):
        yield k, {n: a[order[at:to]] for n, a in arrays.items()}


def _cut(batches: Iterator[pa.RecordBatch], rows: int, most: int) -> Iterator[tuple[int, list[pa.RecordBatch], list[bytes]]]:
    """(block number, slices of batches, texts) for a task's rows. Blocks are cut by rows and bytes of text alone: batches end
    earlier the wider the rows are, and a block goes on into the next one."""
    block, parts, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        at = 0
        for k, text in enumerate(batch.column(1), 1):
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= most or len(texts) >= rows:
                yield block, [*parts, batch.slice(at, k - at)], texts
                block, at, parts, texts, size = block + 1, k, [], [], 0
        if at < batch.num_rows:
            parts.append(batch.slice(at))
    if texts:
        yield block, parts, texts


def _ids(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([p.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts])


def ship_texts(kept: int, rows: int = BLOCK_ROWS, most: int = BLOCK_BYTES):
    """Blocks as rows of compressed texts, with the first ``kept`` columns after the text as Arrow bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for block, parts, texts in _cut(batches, rows, most):
            sink = pa.BufferOutputStream()
            others = [pa.RecordBatch.from_arrays(p.columns[2:2 + kept], names=[f"c{k}" for k in range(kept)]) for p in parts]
            with pa.ipc.new_stream(sink, others[0].schema) as out:
                for part in others:
                    out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([_ids(parts).tobytes()], pa.binary()),
                 pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()),
                 pa.array([press.compress(b"".join(texts))], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["block", "ids", "sizes", "texts", "others"])
    return run


def shipped_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(block number, ids, texts) of written blocks; one block's texts at a time are in memory."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in ("block", "ids", "sizes", "texts")}
            ids, starts, data = block_texts(row)
            yield row["block"], ids, [data[a:z] for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])]


def block_texts(row) -> tuple[np.ndarray, np.ndarray, bytes]:  # noqa: ANN001
    sizes = np.frombuffer(row["sizes"], "<i8")
    return np.frombuffer(row["ids"], "<i8"), np.cumsum(sizes) - sizes, zstandard.ZstdDecompressor().decompress(row["texts"])
