"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

P(w | h) is the discounted count of h w over the count of h if h w was seen, else alpha(h) P(w); P(w) is the discounted
count of w over all tokens, and words never seen share what the discounts leave. alpha(h) makes the sum
over the vocabulary and one unseen word exactly one.

Counts lie in shards by n-gram hash. A block of documents sends each of its distinct words and bigrams once, with its
training count, and gets total counts back in the order it sent them, so that no hash and no text travels twice; every
bigram has one owner among the blocks, which adds it to the sums of its history. A word that a third of all documents
hold is still one entry per block. Words are known by 64-bit hashes, n-grams by hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.llm.blocks import SHIPPED, block_texts, by_key, pack, ship_texts, shipped_blocks, unpack
from probitas.llm.common import materialize, ship_package

ROWS, BYTES = 3000, 7_000_000  # a block: more documents share more n-grams
HASHED = 500_000                # bytes of texts hashed together
CUT = 5                         # counts above this get the discount of this
END, START = np.uint64(0xE4D), np.uint64(0x57A27)  # hashes of the end of a text and of what stands before it


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_PLACES = 64
_TABLE = _mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(_PLACES, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, tokens per text): the words, A-Z lower-cased, and an end after each text."""
    sizes = np.cumsum([len(t) for t in texts])
    edges = [0, *(np.flatnonzero(np.diff(sizes // HASHED)) + 1).tolist(), len(texts)]
    parts = [_tokens(texts[a:z]) for a, z in zip(edges, edges[1:])]
    return np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = ends - starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, sizes)
    value = _TABLE[place % _PLACES, data[at]]
    far = np.flatnonzero(place >= _PLACES)
    value[far] = _mix(value[far] + (place[far] // _PLACES).astype(np.uint64))
    first = np.cumsum(sizes) - sizes
    words = _mix(np.add.reduceat(value, first)) if len(first) else np.zeros(0, np.uint64)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    which = np.searchsorted(text_ends, starts, "right")
    counts = np.bincount(which, minlength=len(texts)) + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    out[np.arange(len(words)) + which] = words  # an end has gone before for each earlier text
    return out, counts


@dataclass
class Block:
    """A block's tokens, numbered by its distinct words and bigrams; both lists in the order in which they are sent."""
    counts: np.ndarray      # tokens per text
    words: np.ndarray       # distinct words by shard, then hash
    word: np.ndarray        # number of each token
    history: np.ndarray     # number of the token before; -1 at the start
    grams: np.ndarray       # distinct bigrams by shard, then hash
    gram: np.ndarray        # number of each token's bigram
    gram_word: np.ndarray   # per bigram the number of its word
    gram_history: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        token, counts = tokens(texts)
        words, word = np.unique(token, return_inverse=True)
        history = np.concatenate([[-1], word[:-1]])
        history[np.cumsum(counts) - counts] = -1
        before = np.where(history >= 0, words[np.maximum(history, 0)], START)
        grams, first, gram = np.unique(_mix(before * np.uint64(0x94D049BB133111EB) + words[word]), return_index=True, return_inverse=True)
        return cls(counts, words, word, history, grams, gram, word[first], history[first])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted hashes are sorted by shard."""
    return ((hashes >> np.uint64(32)).astype(np.int64) * shards) >> 32


SENT = {"low": "<u4", "mid": "<u2", "high": "u1", "n": "<u4"}  # the top byte follows from the shard


def _sent(hashes: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    return {"low": (hashes & np.uint64(0xFFFFFFFF)).astype("<u4"), "mid": (hashes >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2"),
            "high": (hashes >> np.uint64(48) & np.uint64(0xFF)).astype("u1"), "n": n.astype("<u4")}


def _key(x: dict[str, np.ndarray]) -> np.ndarray:
    return x["low"].astype(np.uint64) | x["mid"].astype(np.uint64) << np.uint64(32) | x["high"].astype(np.uint64) << np.uint64(48)


def _flagged(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids carry the row's part in their lowest bit: 1 for training."""
    return ids >> 1, (ids & 1).astype(bool)


def _count_block(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in shipped_blocks(batches):
            b, (_, train) = Block.of(texts), _flagged(ids)
            used = np.repeat(train, b.counts)
            parts = {}
            for name, hashes, which in (("words", b.words, b.word), ("grams", b.grams, b.gram)):
                n = np.bincount(which[used], minlength=len(hashes))
                for k, x in by_key(shard_of(hashes, shards), _sent(hashes, n)):
                    parts.setdefault(k, {})[name] = pack(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(parts), pa.int32()), pa.array([number] * len(parts), pa.int64()),
                 pa.array([p.get("words", b"") for p in parts.values()], pa.binary()),
                 pa.array([p.get("grams", b"") for p in parts.values()], pa.binary())], names=["shard", "block", "words", "grams"])
    return run


def _total(blobs: pd.Series) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per block the total count of each entry, and whether the block owns it (is the first that trains on it); all totals."""
    parts = [unpack(b, SENT) for b in blobs]
    keys = np.concatenate([_key(p) for p in parts])
    n = np.concatenate([p["n"] for p in parts]).astype(np.int64)
    distinct, which = np.unique(keys, return_inverse=True)
    totals = np.bincount(which, weights=n, minlength=len(distinct)).astype(np.int64)  # exact below 2 ** 53
    trained = np.flatnonzero(n > 0)
    owner = np.full(len(distinct), -1, np.int64)
    owner[which[trained[::-1]]] = trained[::-1]  # the first one is written last
    owned = owner[which] == np.arange(len(which))
    ends = np.cumsum([len(p["n"]) for p in parts])[:-1]
    return np.split(totals[which], ends), np.split(owned, ends), totals


def _count_shard(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("block", kind="stable")
    words, _, all_words = _total(part["words"])
    grams, owned, all_grams = _total(part["grams"])
    of = lambda x: np.bincount(x[(x > 0) & (x <= CUT + 1)], minlength=CUT + 2)[:CUT + 2].tolist()
    n = len(part)
    return pd.DataFrame({
        "block": part["block"].to_numpy(), "shard": part["shard"].to_numpy(),
        "words": [w.astype("<u8").tobytes() for w in words], "grams": [(g * 2 + o).astype("<u8").tobytes() for g, o in zip(grams, owned)],
        "tokens": [int(all_words.sum())] + [0] * (n - 1), "types": [int((all_words > 0).sum())] + [0] * (n - 1),
        "word_counts": [of(all_words)] + [[0] * (CUT + 2)] * (n - 1), "gram_counts": [of(all_grams)] + [[0] * (CUT + 2)] * (n - 1)})


@dataclass(frozen=True)
class Discounts:
    """What is taken off a count: by Good-Turing up to CUT, and as much as from CUT above it."""
    taken: tuple[float, ...]  # index 0 to CUT

    @classmethod
    def fit(cls, of: list[int]) -> Discounts:
        """``of[r]``: n-grams seen r times, r up to CUT + 1. Katz's formula where it gives a discount between 0 and r; else the
        absolute discount n1 / (n1 + 2 n2) (one half without any data)."""
        n1, n2 = of[1], of[2]
        flat = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        taken = [0.0]
        tail = (CUT + 1) * of[CUT + 1] / n1 if n1 else 0.0
        for r in range(1, CUT + 1):
            d = None
            if of[r] and of[r + 1] and tail < 1:
                kept = ((r + 1) * of[r + 1] / of[r] / r - tail) / (1 - tail)
                d = r * (1 - kept)
            taken.append(d if d is not None and 0.01 <= d <= 0.99 * r else flat)
        return cls(tuple(taken))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.array(self.taken)[np.minimum(counts, CUT)]


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int
    words: Discounts
    grams: Discounts
    unseen: float  # probability that the discounts of single words leave to words never seen

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        p = (counts - self.words.of(counts)) / max(self.tokens, 1)
        return np.where(counts > 0, p, self.unseen)


SUMS = {"low": "<u4", "mid": "<u2", "high": "u1", "n": "<u8", **{f"t{r}": "<u4" for r in range(1, CUT + 1)}, "rest": "<u4", "seen": "<f8", "asked": "u1"}
STATE = {"asked": "<u4", "row": "<u4", "times": "<u4"}
PARTIAL = {"id": "<i8", "n": "<i8", "known": "<i8", "base": "<f8", "score": "<f8", "train": "u1"}


def _score_block(shards: int, model: Totals):
    """What a block can score by itself, what its bigrams add to their histories, and which backoff weights it needs."""
    def run(texts: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        number = int(texts["block"].iloc[0])
        ids, starts, data = block_texts(texts.iloc[0])
        b = Block.of([data[s:e] for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])])
        own_ids, train = _flagged(ids)
        counted = counted.sort_values("shard")
        c = np.frombuffer(b"".join(counted["words"]), "<u8").astype(np.int64)     # per word
        packed = np.frombuffer(b"".join(counted["grams"]), "<u8").astype(np.int64)
        cg, owned = packed >> 1, (packed & 1).astype(bool)                        # per bigram
        starts_seen = int(counted["starts"].iloc[0])  # training texts: each follows the start once
        p1 = model.unigram(c)
        of_history = np.where(b.gram_history >= 0, c[np.maximum(b.gram_history, 0)], starts_seen)
        seen = cg > 0
        log_gram = np.where(seen, np.log10(np.maximum(cg - model.grams.of(cg), 1e-300) / np.maximum(of_history, 1)), np.log10(p1[b.gram_word]))
        row = np.repeat(np.arange(len(ids)), b.counts)
        base = np.log10((c + 1) / (model.tokens + (model.types + 1)))
        # tokens of unseen bigrams whose history was seen need its backoff weight
        back = np.flatnonzero(~seen[b.gram] & (of_history[b.gram] > 0))
        slot = b.history[back] + 1  # 0: the start
        needed, which = np.unique(slot, return_inverse=True)
        pair, times = np.unique(which * len(ids) + row[back], return_counts=True)
        state = {"asked": (pair // max(len(ids), 1)).astype("<u4"), "row": (pair % max(len(ids), 1)).astype("<u4"), "times": times.astype("<u4")}
        partial = {"id": own_ids, "n": b.counts, "known": np.bincount(row, (c > 0)[b.word], len(ids)).astype("<i8"),
                   "base": np.bincount(row, base[b.word], len(ids)), "score": np.bincount(row, log_gram[b.gram], len(ids)), "train": train.astype("u1")}
        # sums over the owned bigrams of each history
        slots = len(b.words) + 1
        at = b.gram_history[owned] + 1
        kind = np.minimum(cg[owned], CUT + 1)
        hist = np.bincount(at * (CUT + 2) + kind, minlength=slots * (CUT + 2)).reshape(slots, CUT + 2)
        asked = np.zeros(slots, np.uint8)
        asked[needed] = 1
        hashes = np.concatenate([[START], b.words])
        send = np.flatnonzero((hist.sum(axis=1) > 0) | (asked > 0))
        sums = {**{k: v for k, v in _sent(hashes[send], hashes[send] * 0).items() if k != "n"},
                "n": np.concatenate([[starts_seen], c])[send].astype("<u8"), **{f"t{r}": hist[send, r].astype("<u4") for r in range(1, CUT + 1)},
                "rest": hist[send, CUT + 1].astype("<u4"), "seen": np.bincount(at, p1[b.gram_word[owned]], slots)[send], "asked": asked[send]}
        out = [(number, k, pack(v), None, None, None) for k, v in by_key(shard_of(hashes[send], shards), sums)]
        place = shard_of(hashes[needed], shards)
        # weights come back by shard, in the order in which they were asked for
        order = np.argsort(place, kind="stable")
        rank = np.empty(len(needed), np.int64)
        rank[order] = np.arange(len(needed))
        state["asked"] = rank[state["asked"]].astype("<u4")
        out.append((number, None, None, pack(partial), pack(state), len(ids)))
        return pd.DataFrame(out, columns=["block", "shard", "sums", "partial", "state", "rows"]).astype({"shard": "Int32", "rows": "Int64"})
    return run


def _weigh(model: Totals):
    """Backoff weights of a shard's histories, returned to the blocks that asked."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x, SUMS) for x in part["sums"]]
        key = np.concatenate([_key(p) for p in parts])
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        total = lambda x: np.bincount(which, x, len(distinct))
        join = lambda n: np.concatenate([p[n] for p in parts])
        left = sum(total(join(f"t{r}")) * model.grams.taken[r] for r in range(1, CUT + 1)) + total(join("rest")) * model.grams.taken[CUT]
        alpha = (left / np.maximum(join("n")[first].astype(float), 1)) / np.maximum(1 - total(join("seen")), 1e-300)
        log = np.log10(np.maximum(alpha, 1e-300))[which]
        ends = np.cumsum([len(p["n"]) for p in parts])
        out = []
        for block, p, e in zip(part["block"], parts, ends):
            asked = p["asked"] > 0
            if asked.any():
                out.append((block, int(part["shard"].iloc[0]), log[e - len(asked):e][asked].astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "weights"])
    return run


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of training texts in each block."""
    for batch in batches:
        n = [int((np.frombuffer(ids.as_py(), "<i8") & 1).sum()) for ids in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])


def _finish(states: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    partial, state = unpack(states["partial"].iloc[0], PARTIAL), unpack(states["state"].iloc[0], STATE)
    log = np.frombuffer(b"".join(weights.sort_values("shard")["weights"]), "<f8") if len(weights) else np.zeros(0)
    more = np.bincount(state["row"], log[state["asked"]] * state["times"], len(partial["n"])) if len(log) else 0.0
    return pd.DataFrame({"id": partial["id"], "train": partial["train"] > 0, "n_tokens": partial["n"], "n_known": partial["known"],
                         "base_score": partial["base"], "score": partial["score"] + more})


def score_documents(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, trained (whether it was learnt from), n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score, both log10 probabilities of the whole text.

    The texts are written once as numbered blocks, which all steps read, so the result does not depend on how the input is
    split when it is read. Ids are longs of less than 63 bits.

    Defined cases: null and empty texts are one end token; ``trains`` that is null counts as false; null ids are scored and come
    back null; repeated rows are counted and scored each; with nothing to learn from the base score gives every token
    1 / (0 + 0 + 1) and the model gives every token probability one, as the one unseen word;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    flag = F.when(F.coalesce(trains, F.lit(False)), 1).otherwise(0)
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 62)))
    source = docs.select((known * 2 + flag).alias("id"), F.col(text_col).alias("text"))
    shipped = materialize(source.mapInArrow(ship_texts(0, ROWS, BYTES), SHIPPED), "katz-blocks").drop("others")
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = shipped.mapInArrow(_count_block(shards), "shard int, block long, words binary, grams binary")
    counted = materialize(sent.groupBy("shard").applyInPandas(
        _count_shard, "block long, shard int, words binary, grams binary, tokens long, types long, word_counts array<long>, gram_counts array<long>"),
        "ngram-counts")
    at = lambda name: [F.sum(F.col(name)[r]).alias(f"{name}{r}") for r in range(CUT + 2)]
    row = counted.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), *at("word_counts"), *at("gram_counts")).first()
    words, grams = (Discounts.fit([row[f"{n}{r}"] or 0 for r in range(CUT + 2)]) for n in ("word_counts", "gram_counts"))
    n, of = row["tokens"] or 0, [row[f"word_counts{r}"] or 0 for r in range(CUT + 2)]
    more = (row["types"] or 0) - sum(of[1:CUT + 1])
    left = sum(of[r] * words.taken[r] for r in range(1, CUT + 1)) + more * words.taken[CUT]
    model = Totals(n, row["types"] or 0, words, grams, left / n if n else 1.0)
    starts = shipped.select("ids").mapInArrow(_training, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    back = counted.select("block", "shard", "words", "grams", F.lit(starts).alias("starts"))
    scored = materialize(shipped.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
        _score_block(shards, model), "block long, shard int, sums binary, partial binary, state binary, rows long"), "ngram-sums")
    weights = (scored.where(F.col("shard").isNotNull()).select("block", "shard", "sums").groupBy("shard")
               .applyInPandas(_weigh(model), "block long, shard int, weights binary"))
    states = scored.where(F.col("partial").isNotNull()).select("block", "partial", "state")
    out = states.groupBy("block").cogroup(weights.groupBy("block")).applyInPandas(
        _finish, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.when(F.col("id") != -(2 ** 62), F.col("id")).alias(id_col), F.col("train").alias("trained"), "n_tokens", "n_known",
                      F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
