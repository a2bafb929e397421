"""Best-fit packing: the encoder, the sweep, the dealing of ranks, and whole packings against sequential best fit."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from llm.test_tokens import BYTES, PIECES, plain, random_texts

from probitas.llm import best_fit
from probitas.llm.tokenizing import ByteCoder, tokenizer_json


def sequential(sizes, window):
    """Best fit, longest first: the number of sequences."""
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else window
        n += gap == window and at == len(gaps)
        if gap > s:
            bisect.insort(gaps, gap - s)
    return n


def test_byte_coder_agrees_with_the_library_on_any_text():
    coder, tok = ByteCoder(tokenizer_json(BYTES)), plain(BYTES)
    latin = [p for p in PIECES if max(p) <= "ɏ"] + ["\n\n", "x\n"]
    rng = random.Random(12)
    for t in random_texts(11, 500, 150) + ["".join(rng.choices(latin, k=rng.randint(0, 60))) for _ in range(1000)]:
        assert coder.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert coder.encode(None) == coder.encode("") == b""


def test_deal_gives_every_rank_a_place_that_holds_it():
    rng = random.Random(3)
    for _ in range(200):
        window, segments, sizes = 64, [], {}
        bound = 32
        for part in range(rng.randint(1, 6)):
            low = rng.randint(1, bound)
            for state in (best_fit.LEFT, best_fit.GAP):
                xs = sorted((rng.randint(low, bound) for _ in range(rng.randint(0, 12))), reverse=True)
                sizes[part, state] = xs
                for c in sorted({window // x for x in xs}):
                    at = [k for k, x in enumerate(xs) if window // x == c]
                    segments.append((part, state, c, at[0], at[-1] + 1, xs[at[-1]], xs[at[0]]))
            bound = low
        rng.shuffle(segments)
        rows, opened = best_fit.deal(segments, window, 7)
        room = {(p, k): g for (p, s), xs in sizes.items() if s == best_fit.GAP for k, g in enumerate(xs)}
        room |= {(-1, k): window for k in range(7, opened)}
        seen = set()
        for part, a, b, each, to, at, step in rows:
            for i in range(a, b):
                room[to, at + step * ((i - a) // each)] -= sizes[part, best_fit.LEFT][i]
                assert (part, i) not in seen and to < part
                seen.add((part, i))
        assert min(room.values(), default=0) >= 0
        assert len(seen) == sum(len(xs) for (_, s), xs in sizes.items() if s == best_fit.LEFT)


SIZES = {"mixed": lambda r: r.randint(1, 300), "short": lambda r: r.randint(1, 12), "equal": lambda r: 70,
         "few": lambda r: r.choice([256, 255, 1, 128, 129, 64])}


@pytest.mark.parametrize("kind", SIZES)
def test_place_is_about_as_tight_as_sequential_best_fit(spark, kind):
    rng, window = random.Random(kind), 256
    sizes = [min(window, SIZES[kind](rng)) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, size long").repartition(5)
    out = best_fit.place(df, window).collect()
    short = {k: s for k, s in enumerate(sizes) if s < window}
    assert {r.uid: r.size for r in out} == short and len(out) == len(short)
    used = {}
    for r in out:
        used[r.seq] = used.get(r.seq, 0) + r.size
    assert max(used.values()) <= window
    assert len(used) <= 1.02 * sequential(short.values(), window) + 4 * 12  # four partitions may leave a part-filled sequence a round


@pytest.mark.parametrize("window", [16, 2048])
def test_pack_best_fit(docs, odd_texts, window):
    tok, texts = plain(BYTES), odd_texts * 3
    out = best_fit.pack_best_fit(docs(texts), BYTES, window=window).collect()
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    lengths = []
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            part = ids[at:at + r.length].tobytes()
            assert (r.piece, r.start, bytes(r.ids), r.ids_crc32) == (n, at, part, zlib.crc32(part))
            assert r.length == window or n == 0
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
    assert len(sequences) <= sequential(lengths, window) + 8
    assert best_fit.pack_best_fit(docs([]), BYTES).collect() == []
    assert len(best_fit.pack_best_fit(docs(["a", "a"], [None, 3]), BYTES, with_ids=False).collect()) == 2


def test_query_packs_the_whole_table(spark):
    from probitas.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op11_best_fit_packing"](spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    tok = plain(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sums = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == {k: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    total = sum(sums.values())
    assert out.select("sequence_id").distinct().count() <= 1.02 * total / 2048 + 10
