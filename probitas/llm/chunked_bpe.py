"""Byte-level BPE with content-defined chunk reuse.

A rolling hash cuts every text where its last 16 bytes say so, whatever stands before, so
documents that share a passage share its chunks. Documents are range-partitioned by their
smallest chunk hash (then id: equal hashes may span partitions, so no group of copies is hot), which
brings copies and near copies into one task; there every distinct chunk is encoded once and
remembered. Chunk joins are then repaired: the text around a join is re-encoded from one
word break to another, and the window widens until its ends agree with token ends of both chunks.

Why that is exact: the tokenizer's pattern always ends a piece between a printable character and white
space, looks ahead but never back, and merges never leave a piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas.llm.common import ship_package
from probitas.llm.tokenizing import byte_characters, load_tokenizer, tokenizer_json

WINDOW = 16              # bytes that decide on a cut
MASK = np.uint32(1023)   # a cut every 1,024 bytes on average
MIN_CHUNK, MAX_CHUNK = 256, 8192
REMEMBERED = 32_000_000  # bytes of chunk texts a task remembers; beyond that it starts afresh

_GEAR = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text; never inside a character."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for step in (1, 2, 4, 8):  # h[i] covers bytes i to i + 2 * step - 1
        h = h[:-step] * np.uint32(2654435761) + h[step:]
        h ^= h >> np.uint32(15)
    spots = np.flatnonzero((h & MASK) == 0) + WINDOW
    spots = spots[spots < n]
    out, last = [], 0
    for p in [*spots.tolist(), n]:
        while p - last > MAX_CHUNK:
            last = _at_character(b, last + MAX_CHUNK)
            out.append(last)
        if p == n or p - last >= MIN_CHUNK:
            p = _at_character(b, p)
            if p > last:
                out.append(p)
                last = p
    return out


def _at_character(b: np.ndarray, p: int) -> int:
    while p < len(b) and b[p] & 0xC0 == 0x80:
        p += 1
    return p


class ChunkEncoder:
    """Ids of whole texts, equal to those of the tokenizer file, by chunks that are encoded once."""

    def __init__(self, json_text: str):
        import tiktoken
        spec = json.loads(json_text)
        byte_of = {c: x for x, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by the tokenizer
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.exact = load_tokenizer(json_text)
        self.spelt = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.spelt[i] = t
        self.lengths = np.array([len(t) for t in self.spelt], np.int64)
        self.decimal = [str(i) for i in range(len(self.spelt))]
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.size = self.encoded = self.reused = 0

    def _ids(self, piece: bytes) -> list[int]:
        text = piece.decode()
        if text.isascii() or max(text) <= "ɏ":  # beyond Latin, libraries may follow other versions of Unicode
            return self.fast.encode(text, allowed_special="all")
        return self.exact.encode(text, add_special_tokens=False).ids

    def _chunk(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token ends of a chunk encoded on its own."""
        got = self.known.get(piece)
        if got is None:
            ids = np.array(self._ids(piece), np.int32)
            got = ids, np.cumsum(self.lengths[ids])
            self.size += len(piece)
            if self.size > REMEMBERED:
                self.known, self.size = {}, len(piece)
            self.known[piece] = got
            self.encoded += 1
        else:
            self.reused += 1
        return got

    def encode(self, data: bytes) -> list[int]:
        ends = cuts(data)
        if len(ends) < 2:
            return self._chunk(data)[0].tolist() if data else []
        b = np.frombuffer(data, np.uint8)
        breaks = np.flatnonzero(_SPACE[b[1:]] & _PRINTED[b[:-1]]) + 1
        starts = [0, *ends[:-1]]
        chunks = [self._chunk(data[s:e]) for s, e in zip(starts, ends)]
        reach = 1
        while True:
            windows = self._windows(breaks, ends, len(data), reach)
            out = self._joined(data, starts, ends, chunks, windows)
            if out is not None:
                return out
            reach *= 2  # no agreement at the ends of a window: take in more word breaks

    @staticmethod
    def _windows(breaks: np.ndarray, ends: list[int], n: int, reach: int) -> list[tuple[int, int]]:
        """What is to be encoded again: around each join, ``reach`` word breaks to either side."""
        joins = np.array(ends[:-1])
        left = np.searchsorted(breaks, joins, "right") - reach
        right = np.searchsorted(breaks, joins, "left") + reach - 1
        lo = np.where(left >= 0, breaks[np.maximum(left, 0)] if len(breaks) else 0, 0)
        hi = np.where(right < len(breaks), breaks[np.minimum(right, len(breaks) - 1)] if len(breaks) else n, n)
        merged: list[tuple[int, int]] = []
        for a, z in zip(lo.tolist(), hi.tolist()):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(z, merged[-1][1])
            else:
                merged.append((a, z))
        return merged

    def _joined(self, data, starts, ends, chunks, windows) -> list[int] | None:
        """Tokens of the chunks outside the windows and of the windows encoded anew; None where a window's end
        is not a token end of the chunk that it cuts."""
        out: list[int] = []
        at, w, k = 0, 0, 0
        while at < len(data):
            if w < len(windows) and windows[w][0] == at:
                if windows[w][1] > at:
                    out += self._ids(data[at:windows[w][1]])
                    at = windows[w][1]
                w += 1
                continue
            while ends[k] <= at:
                k += 1
            stop = min(ends[k], windows[w][0]) if w < len(windows) else ends[k]
            ids, token_ends = chunks[k]
            first = np.searchsorted(token_ends, at - starts[k], "right")
            last = np.searchsorted(token_ends, stop - starts[k], "right")
            begins = token_ends[first - 1] if first else 0
            if begins != at - starts[k] or not last or token_ends[last - 1] != stop - starts[k]:
                return None
            out += ids[first:last].tolist()
            at = stop
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")


def smallest_chunk(texts: pd.Series) -> pd.Series:
    """The smallest hash of a text's chunks, 0 for an empty text: where copies and near copies meet."""

    def least(text):
        data = (text or "").encode()
        ends = cuts(data)
        return min((xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip([0, *ends[:-1]], ends)), default=0) >> 1
    return pd.Series([least(t) for t in texts], dtype="int64")


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, ids (array of int) and decoded (string). Strings of special tokens are special tokens.

    Defined cases: null and empty texts have no ids and decode to the empty text; null or repeated ids
    and repeated rows are encoded row by row; a text of any length is encoded whole; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for whole in batches:
            coder = coder or ChunkEncoder(model.value)
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts, id_hashes, text_hashes, all_ids, texts = [], [], [], [], []
                for text in batch.column(1):
                    ids = coder.encode((text.as_py() or "").encode())
                    decoded = coder.decode(ids)
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
                    all_ids.append(ids if with_ids else None)
                    texts.append(decoded if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()),
                     pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                    names=["__id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    routed = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
              .withColumn("__route", F.pandas_udf(smallest_chunk, "long")("__text"))
              .repartitionByRange("__route", "__id").sortWithinPartitions("__route").select("__id", "__text"))
    out = (routed.mapInArrow(encode, f"__id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
           .withColumnRenamed("__id", id_col))
    return out if with_ids else out.drop("ids", "decoded")
