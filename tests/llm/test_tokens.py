"""Byte-level encoding by chunks, and packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from probitas.llm import chunked_bpe, packing
from probitas.llm.tokenizing import WordMemo, tokenizer_json

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'ll", "漢", "字", "。", "1", "23", "!", "<|endoftext|>", "<|endof", "text|>", "\u00a0",
          "\u3000", "\x1c", "🙂", "é", "word ", "the quick ", "İ", "Σ", "ς", "ß", "²", "½", "ª", "«", "_", "-", "Straße ", "d'un ", "\x85", "ŉ",
          "ǅ", "\u0301", "¨"]


def plain(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, longest))) for _ in range(n)]


def test_chunks_agree_with_the_library_on_any_text():
    coder, tok = chunked_bpe.ChunkEncoder(tokenizer_json(BYTES)), plain(BYTES)
    shared = "".join(random.Random(5).choices(PIECES, k=4000))
    for t in random_texts(1, 120, 2500) + [x + shared for x in random_texts(2, 10, 60)]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert coder.encode(t.encode()) == ids
        assert coder.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    assert coder.reused > 10  # the shared tail is cut alike behind every head


def test_cuts_follow_content():
    body = bytes(random.Random(3).choices(range(32, 127), k=50_000))
    a, b = chunked_bpe.cuts(body), chunked_bpe.cuts(b"something else in front " + body)
    assert a[-1] == len(body) and all(0 < y - x <= chunked_bpe.MAX_CHUNK + 3 for x, y in zip([0, *a], a))
    assert len({x + 24 for x in a} & set(b)) > 0.8 * len(a)
    assert chunked_bpe.cuts(b"") == [] and chunked_bpe.cuts("é".encode()) == [2]


def test_encode_documents(docs, odd_texts):
    tok = plain(BYTES)
    out = {r.doc_id: r for r in chunked_bpe.encode_documents(docs(odd_texts), BYTES).collect()}
    assert len(out) == len(odd_texts)
    for k, t in enumerate(odd_texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (out[k].ids, out[k].n_tokens, out[k].decoded) == (ids, len(ids), tok.decode(ids, skip_special_tokens=False))
        assert out[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(out[k].decoded.encode()).hexdigest()
    assert chunked_bpe.encode_documents(docs([]), BYTES).collect() == []


def test_word_memo_agrees_with_the_library_on_any_text():
    memo, tok = WordMemo(tokenizer_json(WORDS)), plain(WORDS)
    for t in random_texts(4, 400, 120):
        assert memo.encode([t])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert memo.encode([None, ""]) == [b"", b""]


def test_fill_is_the_best_subset_sum():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = packing.fill(room, counts)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in got.items())


def test_plan_uses_every_piece_once_and_stays_small():
    rng = random.Random(7)
    counts = {x: rng.randint(1, 10 ** 6) for x in range(1, 257)}
    patterns = packing.plan(counts, 256)
    used = {}
    for times, p in patterns:
        assert sum(x * n for x, n in p.items()) <= 256
        for x, n in p.items():
            used[x] = used.get(x, 0) + times * n
    assert used == counts and len(patterns) < 256 * 8
    bins = sum(t for t, _ in patterns)
    assert bins <= 1.02 * sum(x * n for x, n in counts.items()) / 256 + sum(n for x, n in counts.items() if x > 128)


@pytest.mark.parametrize("window", [16, 2048])
def test_pack(docs, odd_texts, window):
    tok, texts = plain(WORDS), odd_texts * 3
    out = packing.pack(docs(texts), WORDS, window=window).collect()
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            part = ids[at:at + r.length].tobytes()
            assert (r.start, r.doc_tokens, bytes(r.ids), r.ids_crc32) == (at, len(ids), part, zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
    assert packing.pack(docs([]), WORDS).collect() == []
    assert len(packing.pack(docs(["a", "a"], [None, 3]), WORDS, with_ids=False).collect()) == 2
