"""Removal of repeated passages by suffix arrays over shards.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document of smaller id.

1. Anchors. Of the 16-byte grams of every ``length``-byte window the one of smallest hash is an anchor, so equal
   windows share an anchor at the same place. An anchor's context is all that such windows can reach.
2. Shards. Anchors meet by hash; those that a count over all texts shows to fill much of a shard are dealt over as many
   shards as they need. Equal contexts of larger ids are covered at once; where several contexts of an anchor agree on the
   16 bytes before or behind it (as they must to share a window), one of each is kept.
3. Suffix arrays. The kept contexts of a shard are sorted as suffixes (Larsson-Sadakane refinement), in parts of bounded
   size that keep an anchor's contexts together; common prefixes of neighbours (Kasai's, one comparison per run) group
   equal windows; all but the smallest id are covered.
4. Merging. Of anchors that were dealt over shards, or have more contexts than a part holds, each part sends the first of
   each of their windows as a sorted run to a range of window keys, where runs are merged by binary search.
5. Removal. Covered ranges meet their texts; texts themselves are only moved compressed, by blocks of rows.

The count decides on the dealing alone, never on the result. Numpy does the work inside tasks, on blocks, shards, parts and
ranges; the number of shards follows the partitions, or the bytes of text where there are few partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probitas.llm.blocks import NULL_ID, SHIPPED, block_texts, by_key, gather, give_back, pack, ship_texts, shipped_blocks, unpack
from probitas.llm.common import materialize, ship_package

GRAM = 16
SEGMENT = 200_000                          # bytes hashed together; longer texts are cut with an overlap


@dataclass(frozen=True)
class Repeats:
    length: int = 50            # bytes
    frequent: float = 0.25      # share of a mean shard's anchors from which an anchor is dealt over several shards
    shards_per_partition: int = 5
    shard: int = 250_000        # anchors of a mean shard at most, whatever the number of partitions
    part: int = 250_000         # bytes of contexts in one suffix array, up to twice as many to keep an anchor's together

    @property
    def grams(self) -> int:
        return self.length - GRAM + 1


# ---- hashing ---------------------------------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each position on; never 0."""
    h = _BYTE[data]
    for step in (1, 2, 4, 8):
        h = h[:-step] * np.uint64(0x94D049BB133111EB) + h[step:]
        h ^= h >> np.uint64(32)
    return np.maximum(_mix(h), np.uint64(1))


def _slide(x: np.ndarray, pick, width: int) -> np.ndarray:  # noqa: ANN001
    """pick over x[i:i + width] for every i."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


def _chosen(data: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the anchors, hashes of all grams) over texts laid end to end; no window crosses a text's end."""
    w = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = _slide(h, np.minimum, w)  # one for each window
    crossing = np.zeros(len(least) + 1, np.int64)
    lo = np.clip(doc_ends - length + 1, 0, len(least))
    hi = np.clip(doc_ends, 0, len(least))
    np.add.at(crossing, lo, 1)
    np.add.at(crossing, hi, -1)
    least[np.cumsum(crossing)[:-1] > 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), np.maximum, w) == h), h


def anchor_grams(data: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(positions, gram hashes) of the anchors alone."""
    chosen, h = _chosen(data, doc_ends, length)
    return chosen, h[chosen]


def anchors(data: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(positions, gram hashes, context hashes, bytes of context before, and from the anchor on, 16-bit hashes of the 16
    bytes before and behind the anchor, 0 where there are fewer) over texts laid end to end."""
    chosen, h = _chosen(data, doc_ends, length)
    if not len(h):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.uint16, np.uint16))
    which = np.searchsorted(doc_ends, chosen, "right")
    start = np.concatenate([[0], doc_ends[:-1]])[which]
    before = np.minimum(chosen - start, length - GRAM)
    after = np.minimum(doc_ends[which] - chosen, length)
    context = _mix((before * 256 + after).astype(np.uint64) + np.uint64(7))
    first, last = chosen - before, chosen + after - GRAM
    for at in range(0, 2 * length - GRAM, GRAM):  # grams that cover the context
        context = _mix(context * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(first + at, last)])
    context = _mix(context * np.uint64(0xD6E8FEB86659FD93) + h[last])
    left = np.where(before >= GRAM, h[np.maximum(chosen - GRAM, 0)] | np.uint64(1), np.uint64(0)).astype(np.uint16)
    right = np.where(after >= 2 * GRAM, h[np.minimum(chosen + GRAM, len(h) - 1)] | np.uint64(1), np.uint64(0)).astype(np.uint16)
    return chosen, h[chosen], context, before, after, left, right


def text_anchors(texts: list[bytes], length: int, found=anchors) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """(text number, position in the text, and the rest of ``found``) of all anchors."""
    out, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        ends = np.cumsum([len(t) for _, _, t in held])
        p, *rest = found(data, ends, length)
        which = np.searchsorted(ends, p, "right")
        starts = ends - [len(t) for _, _, t in held]
        number = np.array([k for k, _, _ in held], np.int64)
        offset = np.array([o for _, o, _ in held], np.int64)
        out.append((number[which], p - starts[which] + offset[which], *rest))
        held, size = [], 0

    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), SEGMENT):
            part = t[at:at + SEGMENT + length - 1]
            held.append((k, at, part))
            size += len(part)
            if size >= SEGMENT:
                flush()
    if held:
        flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64, np.uint16, np.uint16))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---- suffix arrays ------------------------------------------------------------------------------

WORD = 7  # bytes packed into one comparison; a byte takes nine bits so that 0 can stand for a text's end


def _words(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The seven bytes from each position on as one number; texts are followed by a gap that sorts first."""
    symbols = np.zeros(len(data) + len(ends) + WORD, np.int64)
    own = np.arange(len(data)) + np.searchsorted(ends, np.arange(len(data)), "right")
    symbols[own] = data.astype(np.int64) + 1
    n = len(symbols) - WORD
    out = np.zeros(n, np.int64)
    for k in range(WORD):
        out = (out << 9) | symbols[k:k + n]
    return out


_PACKED = 21  # bits: arrays up to this size are sorted as (key, key, place) in one number, which is several times faster


def _sorted_places(major: np.ndarray, minor: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by (major, minor), with whether each starts a new pair; all values are below n."""
    if n <= 1 << _PACKED:
        key = np.sort((major << 2 * _PACKED) | (minor << _PACKED) | places)
        places, pair = key & ((1 << _PACKED) - 1), key >> _PACKED
    else:
        pair = major * n + minor
        order = np.argsort(pair, kind="stable")
        places, pair = places[order], pair[order]
    return places, np.concatenate([[True], pair[1:] != pair[:-1]])


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in suffix order, sorted to at least ``depth`` symbols: groups of equal prefix are refined by the rank
    ``h`` symbols on, and h doubles; only groups still unsorted are touched (Larsson-Sadakane)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    first = words >> 9 * (WORD - 3)  # three symbols: 27 bits, and 36 for the place
    key = np.sort((first << 36) | np.arange(n))
    order = key & ((1 << 36) - 1)
    head = np.concatenate([[True], (key[1:] >> 36) != (key[:-1] >> 36)])
    del first, key
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = 0
    h = 3
    while h < depth:
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, n))
        open_slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_slots):
            break
        at = order[open_slots]
        at, new = _sorted_places(rank[at], rank[np.minimum(at + h, n)], at, n)
        order[open_slots] = at
        head[open_slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_slots, 0))
        h *= 2
    return order


def common_prefixes(words: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each slot of the suffix order the symbols shared with the slot before, within the texts.

    As in Kasai's algorithm the value at a position is that of the position before less one if their
    predecessors are neighbours as well; only the first of such a run is compared. ``left``: symbols up to the
    text's end at each position (0 at gaps).
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (left[1:] > 0) & (left[:-1] > 0) & (
        left[before[1:]] > 0) & (left[np.maximum(before[:-1], 0)] > 0)
    starts = np.flatnonzero(~follows)
    value = np.zeros(len(starts), np.int64)
    a, b = starts, before[starts]
    limit = np.where(b >= 0, np.minimum(left[a], left[np.maximum(b, 0)]), 0)
    live = np.flatnonzero(limit > 0)
    while len(live):
        x, y = a[live] + value[live], b[live] + value[live]
        inside = value[live] < limit[live]
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        equal = np.full(len(x), WORD, np.int64)
        nonzero = differ != 0
        equal[nonzero] = (9 * WORD - 1 - np.floor(np.log2(differ[nonzero].astype(np.float64))).astype(np.int64)) // 9
        # log2 of a double may round up to the next power of two; settle that case exactly
        off = nonzero & (equal < WORD)
        top = (WORD - 1 - np.minimum(equal, WORD - 1)) * 9
        equal[off & ((differ >> top) & 511 == 0)] += 1
        value[live] += equal
        live = live[equal == WORD]
    value = np.minimum(value, limit)
    run = np.cumsum(~follows) - 1
    plcp = np.maximum(value[run] - (np.arange(n) - starts[run]), 0)
    return plcp[order]


def equal_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(position, group) of every window of ``length`` bytes in suffix order, windows being equal if their groups are;
    and for every position of the texts laid end to end with gaps its text number, its offset and its word."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    words = _words(np.frombuffer(b"".join(texts), np.uint8), ends)
    order = suffix_array(words, length)  # before the others, whose memory it need not share
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(words)) - np.repeat(ends - sizes + np.arange(len(texts)), sizes + 1)
    left = np.repeat(sizes, sizes + 1) - offset
    group = np.cumsum(common_prefixes(words, left, order) < length)
    slots = np.flatnonzero(left[order] >= length)
    return order[slots], group[slots], text, offset, words


def window_keys(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the windows that start at the given positions."""
    key = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - WORD, WORD), length - WORD]:
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + words[at + k].astype(np.uint64) + np.uint64(1))
    return key


# ---- what the stages exchange, packed ----------------------------------------------------------

ENTRY = {"a": "<u4", "c": "<u4", "c2": "<u2", "left": "<u2", "right": "<u2", "row": "<u2", "pos": "<u8", "id": "<i8", "lo": "u1", "hi": "u1", "deal": "u1"}
COVER = {"row": "<u4", "start": "<i8", "end": "<i8"}
REQUEST = {"row": "<u4", "pos": "<i8", "lo": "u1", "hi": "u1", "shard": "<i4", "part": "<u2", "deal": "u1"}
CONTEXT = {"block": "<i8", "row": "<u4", "id": "<i8", "start": "<i8", "size": "<u2", "part": "<u2", "deal": "u1"}
LEADER = {"key": "<u8", "id": "<i8", "block": "<i8", "row": "<u4", "start": "<i8"}


# ---- the stages ---------------------------------------------------------------------------------

def strip_repeats(docs: DataFrame, how: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text",
                  size_col: str | None = "n_chars") -> DataFrame:
    """The documents with what remains of their texts (a null text comes back empty); ``size_col``, if there is such a column,
    is counted anew. All other columns stay. Cases are as in :func:`remove_repeats`."""
    names = {c: f"d{k}" for k, c in enumerate(docs.columns)}  # clash with no result column
    out = remove_repeats(docs.toDF(*names.values()), how, names[id_col], names[text_col])
    cols = []
    for f in docs.schema.fields:
        col = F.col(names[f.name]) if f.name != text_col else F.col("kept_text")
        cols.append((F.length("kept_text").cast(f.dataType) if f.name == size_col else col).alias(f.name))
    return out.select(*cols)


def _deal_anchors(how: Repeats, shards: int, frequent: np.ndarray, over: np.ndarray):
    """``frequent``: anchors in order, ``over``: the number of shards that each is dealt over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in shipped_blocks(batches):
            row, pos, a, c, lo, hi, left, right = text_anchors(texts, how.length)
            shard, deal = (a >> np.uint64(40)).astype(np.int64) % shards, np.isin(a, frequent)
            spread = _mix((np.int64(block) * 1_000_003 + row[deal] * 7919 + (pos[deal] >> 16) * 104_729).astype(np.uint64))
            shard[deal] = (shard[deal] + (spread >> np.uint64(20)).astype(np.int64) % over[np.searchsorted(frequent, a[deal])]) % shards
            rows = list(by_key(shard, {
                "a": (a & np.uint64(0xFFFFFFFF)).astype("<u4"), "c": (c & np.uint64(0xFFFFFFFF)).astype("<u4"),
                "c2": (c >> np.uint64(32)).astype("<u2"), "left": left, "right": right, "row": row.astype("<u2"),
                "pos": pos.astype("<u8"), "id": ids[row] - row, "lo": lo.astype("u1"), "hi": hi.astype("u1"), "deal": deal.astype("u1")}))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                 pa.array([pack(x) for _, x in rows], pa.binary())], names=["shard", "block", "entries"])
    return run


def _meet(how: Repeats, lots: int):
    """A shard's anchors: what is covered by an equal context, and which contexts need a closer look."""
    sided = how.length - GRAM >= 2 * GRAM - 1  # a window reaches a whole gram before the anchor or behind it

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = _met(part, sided, lots, how.part)
        give_back()
        return out
    return run


def _met(part: pd.DataFrame, sided: bool, lots: int, most: int) -> pd.DataFrame:
    shard = int(part["shard"].iloc[0])
    x = gather(part["entries"], ENTRY)
    block = np.repeat(part["block"].to_numpy(), [len(b) // sum(np.dtype(k).itemsize for k in ENTRY.values()) for b in part["entries"]])
    row = x["row"].astype(np.int64)
    ids = x["id"] + row
    a = x["a"]
    c = x["c"].astype(np.uint64) | (x["c2"].astype(np.uint64) << np.uint64(32))
    order = np.lexsort((ids, c, a))
    a, c, ids = a[order], c[order], ids[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
    first_c = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), 0))
    least = ids[first_c]  # the smallest id of the context
    several = np.zeros(len(a), bool)
    heads = np.flatnonzero(new_c)  # one of each context
    sides = [x[side][order][heads] for side in ("left", "right")] if sided else [np.ones(len(heads), np.uint16)]
    for side in sides:
        same = a[heads].astype(np.uint64) << np.uint64(16) | side
        _, which, times = np.unique(same, return_inverse=True, return_counts=True)
        several |= ((times[which] > 1) & (side > 0))[np.cumsum(new_c) - 1]
    pos, lo, hi = (x[k][order].astype(np.int64) for k in ("pos", "lo", "hi"))
    block, row, deal = block[order], row[order], x["deal"][order]
    over = ids > least
    look = ~over & (several | (deal > 0))
    covers = {"row": row[over].astype("<u4"), "start": (pos - lo)[over], "end": (pos + hi)[over]}
    place, wide = _parts(a[look], (lo + hi)[look], most)
    asked = {"row": row[look].astype("<u4"), "pos": pos[look], "lo": lo[look].astype("u1"), "hi": hi[look].astype("u1"),
             "shard": np.full(look.sum(), shard, "<i4"), "part": place.astype("<u2"), "deal": deal[look] | wide}
    out = [(k, v, None) for k, v in _by_lot(block[over], covers, lots)] + [(k, None, v) for k, v in _by_lot(block[look], asked, lots)]
    return pd.DataFrame(out, columns=["lot", "covers", "requests"])


def _parts(a: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in order of their anchors the number of a part, and whether their anchor is in several parts: a part
    begins with an anchor, or within one that has over ``most`` bytes, and holds at most twice as many."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    times, start = np.diff(np.append(first, len(a))), np.cumsum(size) - size
    wide = np.repeat(np.add.reduceat(size, first) > most, times)
    return np.where(wide, start, np.repeat(start[first], times)) // most, wide.astype(np.uint8)


def _fetch(texts: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
    """The contexts asked for, by shard."""
    if not len(texts) or not len(requests):
        return pd.DataFrame({"shard": [], "contexts": [], "data": []})
    block = int(texts["block"].iloc[0])
    ids, starts, data = block_texts(texts.iloc[0])
    x = gather(requests["requests"], REQUEST)
    row = x["row"].astype(np.int64)
    first = starts[row] + x["pos"] - x["lo"]
    size = x["lo"].astype("<u2") + x["hi"]
    held = {"block": np.full(len(row), block, "<i8"), "row": x["row"], "id": ids[row], "start": x["pos"] - x["lo"], "size": size,
            "part": x["part"], "deal": x["deal"], "first": first}
    press, out = zstandard.ZstdCompressor(level=1), []
    for k, v in by_key(x["shard"].astype(np.int64), held):
        raw = b"".join([data[f:f + s] for f, s in zip(v.pop("first").tolist(), v["size"].tolist())])
        out.append((k, pack(v), press.compress(raw)))
    return pd.DataFrame(out, columns=["shard", "contexts", "data"])


def _look(how: Repeats, ranges: int, lots: int):
    """A shard's contexts in suffix order, part by part: equal windows of larger ids are covered; of windows around anchors
    that are in several parts or shards the first is sent on to the merge."""
    def sorted_part(x: dict[str, np.ndarray], texts: list[bytes]) -> tuple[tuple, dict[str, np.ndarray]]:
        at, group, text, offset, words = equal_windows(texts, how.length)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        ids, size = x["id"][text[at]], np.diff(np.append(heads, len(group)))
        over = ids > np.repeat(np.minimum.reduceat(ids, heads), size)
        covered = np.zeros(len(text), bool)
        covered[at[over]] = True
        start = np.flatnonzero(covered)  # in the order of the contexts
        covers = _joined(x["block"][text[start]], x["row"][text[start]], x["start"][text[start]] + offset[start], how.length)
        # a window counts as dealt out if any of its contexts is; all rows of its smallest id go on
        lead = at[(np.repeat(np.maximum.reduceat(x["deal"][text[at]], heads), size) > 0) & ~over]
        return covers, {"key": window_keys(words, lead, how.length), "id": x["id"][text[lead]], "block": x["block"][text[lead]],
                        "row": x["row"][text[lead]], "start": x["start"][text[lead]] + offset[lead]}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        open_ = zstandard.ZstdDecompressor()
        x = gather(part["contexts"], CONTEXT)
        data = b"".join(open_.decompress(d) for d in part["data"])
        long = x["size"] >= how.length
        x = {k: v[long] for k, v in (x | {"end": np.cumsum(x["size"], dtype=np.int64)}).items()}
        rows, covers = [], []
        for _, own in by_key(x["part"], x):
            size, end = own["size"].tolist(), own["end"].tolist()
            (block, ranges_), sent = sorted_part(own, [data[e - s:e] for s, e in zip(size, end)])
            covers.append({"block": block, **ranges_})
            order = np.argsort(sent["key"], kind="stable")
            sent = {k: v[order] for k, v in sent.items()}
            place = (sent["key"] >> np.uint64(32)).astype(np.int64) * ranges >> 32
            rows += [(None, None, k, pack(v)) for k, v in by_key(place, sent)]
        if covers:
            held = {k: np.concatenate([c[k] for c in covers]) for k in covers[0]}
            rows += [(k, v, None, None) for k, v in _by_lot(held.pop("block"), held, lots)]
        give_back()
        return pd.DataFrame(rows, columns=["lot", "covers", "range", "leaders"]).astype({"lot": "Int64", "range": "Int64"})
    return run


def _joined(block: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Windows, where possible in order, as (blocks, covered ranges): those that overlap the one before are joined to it."""
    if not len(block):
        return block, {"row": row.astype("<u4"), "start": start, "end": start}
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1]) | (start[1:] < start[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return block[first], {"row": row[first].astype("<u4"), "start": start[first], "end": start[last] + length}


def _by_lot(block: np.ndarray, arrays: dict[str, np.ndarray], lots: int) -> list[tuple[int, bytes]]:
    """Rows for several blocks together, so that a shard does not write one cell for every block there is."""
    lot = ((block >> 24) * 1_000_003 + (block & 0xFFFFFF)) % lots
    return [(k, pack(v)) for k, v in by_key(lot, {"block": block.astype("<i8"), **arrays})]


def _per_block(name: str, kinds: dict[str, str]):
    """Cells of a lot dealt out to its blocks."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = gather(part[name], {"block": "<i8", **kinds})
        block = x.pop("block")
        out = pd.DataFrame([(k, pack(v)) for k, v in by_key(block, x)], columns=["block", name])
        del x, block
        give_back()
        return out
    return run


def _merge(how: Repeats, lots: int):
    """Sorted runs of window keys from all shards, merged: a window whose key is in another run with a smaller id is covered."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        runs = [unpack(b, LEADER) for b in part["leaders"]]
        keys = np.unique(np.concatenate([r["key"] for r in runs]))
        least = np.full(len(keys), NULL_ID)
        found = [np.searchsorted(keys, r["key"]) for r in runs]  # binary search of each run in the merged order
        for r, at in zip(runs, found):
            np.minimum.at(least, at, r["id"])
        over = [r["id"] > least[at] for r, at in zip(runs, found)]
        block, row, start = (np.concatenate([r[name][o] for r, o in zip(runs, over)]) for name in ("block", "row", "start"))
        order = np.lexsort((start, row, block))
        out = _by_lot(*_joined(block[order], row[order].astype(np.int64), start[order], how.length), lots)
        give_back()
        return pd.DataFrame(out, columns=["lot", "covers"])
    return run


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, spans array<array<long>>"


def _remove(kept: int, with_text: bool):
    """The result rows of a block: its kept columns and what remains of each text."""
    names = [f"c{k}" for k in range(kept)] + [x.split()[0] for x in RESULT.split(", ")]

    def run(texts: pd.DataFrame, covers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame([], columns=names)
        ids, starts, data = block_texts(texts.iloc[0])
        ends = np.append(starts[1:], len(data))
        x = gather(covers["covers"], COVER) if len(covers) else {k: np.zeros(0, np.int64) for k in COVER}
        row = x["row"].astype(np.int64)
        order = np.lexsort((x["start"], row))
        row, a, z = row[order], x["start"][order], x["end"][order]
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        out = []
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            spans: list[list[int]] = []
            for p, q in zip(a[at[k]:at[k + 1]].tolist(), z[at[k]:at[k + 1]].tolist()):
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], q)
                else:
                    spans.append([p, q])
            text, edges = data[s:e], [0, *[v for sp in spans for v in sp], e - s]
            rest = b"".join(text[p:q] for p, q in zip(edges[::2], edges[1::2]))
            out.append((e - s, e - s - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if with_text else None,
                        rest.decode("utf-8", "ignore") if with_text else None, spans if with_text else None))
        others = pa.ipc.open_stream(texts["others"].iloc[0]).read_all().to_pandas(integer_object_nulls=True)
        return pd.concat([others, pd.DataFrame(out, columns=names[kept:])], axis=1)
    return run


COUNTED = 4_000_000  # anchors counted together in a task


def _count_anchors(how: Repeats, shards: int):
    """Anchors with their numbers, where they are frequent among those counted together, and 0 with the number of all. One
    with over ``frequent`` of a mean shard is left out only where it is rarer than half of that, so half is found."""
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate(held)
        value, times = np.unique(a, return_counts=True)
        many = times * 2 * shards >= how.frequent * len(a)
        value, times = np.append(value[many], np.uint64(0)), np.append(times[many], len(a))
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], names=["a", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, _, texts in shipped_blocks(batches):
            held.append(text_anchors(texts, how.length, anchor_grams)[2])
            if sum(map(len, held)) >= COUNTED:
                yield counted(held)
                held = []
        if held:
            yield counted(held)
    return run


def _frequent_anchors(blocks: DataFrame, how: Repeats, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, in order, that have over ``frequent`` of a mean shard's anchors (or over half of that), and over how many
    shards each is to be dealt."""
    most = int(2 * shards / how.frequent) + 1  # as many can be frequent, and the number of all
    rows = (blocks.mapInArrow(_count_anchors(how, shards), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "a").limit(most).collect())
    found = {r["a"]: r["n"] for r in rows}
    least = how.frequent * found.pop(0, 0) / shards
    kept = sorted((np.uint64(a % 2 ** 64), min(shards, int(np.ceil(n / least + 0.5)))) for a, n in found.items() if n > max(1, least / 2))
    return np.array([a for a, _ in kept], np.uint64), np.array([n for _, n in kept], np.int64)


def _text_bytes(blocks: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(s.as_py(), "<i8").sum()) for s in batch.column(0))], pa.int64())], names=["n"])
    return blocks.select("sizes").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """:func:`materialize`, after which the driver drops the shuffles behind the table; they would stay on the executors' disks
    until it happens to collect its garbage."""
    out = materialize(df, name, **options)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def remove_repeats(docs: DataFrame, how: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: the columns named in ``keep`` (default: all but the text), n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, kept (the remaining bytes), kept_text (the same without characters that were cut in
    two) and spans (the removed [start, end) ranges).

    The texts are written once as numbered blocks, which all steps read, so the result does not depend on how the input is
    split when it is read.

    Defined cases: a null text is empty; texts shorter than ``how.length`` lose nothing; a null id counts as larger than
    all others, and equal ids (null ones too) remove nothing from each other; repeated rows are judged alike; an
    empty table gives an empty result; kept columns named like a result column are dropped in its favour.
    """
    spark = docs.sparkSession
    ship_package(spark)
    result = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in ([c for c in docs.columns if c != text_col] if keep is None else keep) if c not in result]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                         *[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)])
    shipped = _staged(source.mapInArrow(ship_texts(len(kept)), SHIPPED), "repeats-blocks", compression="zstd")  # on the heap, for large pages
    blocks = shipped.drop("others")
    expected = 2 * _text_bytes(blocks) // (how.grams + 1)  # of as many random hashes one is the least of some window
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * how.shards_per_partition, -(-expected // how.shard))
    entries = blocks.mapInArrow(_deal_anchors(how, shards, *_frequent_anchors(blocks, how, shards)), "shard int, block long, entries binary")
    lots = max(12, shards // how.shards_per_partition)
    met = _staged(entries.groupBy("shard").applyInPandas(_meet(how, lots), "lot long, covers binary, requests binary"), "anchors")
    requests = (met.where(F.col("requests").isNotNull()).select("lot", "requests").groupBy("lot")
                .applyInPandas(_per_block("requests", REQUEST), "block long, requests binary"))
    contexts = (blocks.groupBy("block").cogroup(requests.groupBy("block"))
                .applyInPandas(_fetch, "shard int, contexts binary, data binary"))
    looked = _staged(contexts.groupBy("shard").applyInPandas(
        _look(how, lots, lots), "lot long, covers binary, range long, leaders binary"), "suffixes")
    merged = (looked.where(F.col("range").isNotNull()).select("range", "leaders").groupBy("range")
              .applyInPandas(_merge(how, lots), "lot long, covers binary"))
    covers = (met.where(F.col("covers").isNotNull()).select("lot", "covers")
              .unionByName(looked.where(F.col("covers").isNotNull()).select("lot", "covers")).unionByName(merged)
              .groupBy("lot").applyInPandas(_per_block("covers", COVER), "block long, covers binary"))
    schema = ", ".join([f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)] + [RESULT])
    out = (shipped.groupBy("block").cogroup(covers.groupBy("block"))
           .applyInPandas(_remove(len(kept), with_text), schema))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], *(result if with_text else result[:4]))
