"""Exact, faster ways to the ids of public tokenizers, for use inside tasks."""

from __future__ import annotations

import json
import os
import re

import numpy as np

MEMO_WORDS = 500_000  # words that a Python worker remembers from task to task; beyond that it starts afresh
AT_ONCE = 256         # pieces encoded in one call

# The pieces of a lower-case word of Latin letters, digits and marks without an apostrophe, as the pattern
# "letters | one digit | anything else" of word-level vocabularies finds them.
_PIECES = re.compile(r"[^\W\d_]+|[0-9]|[\W_]+")


def tokenizer_json(path: str) -> str:
    """The text of a tokenizer file, read where the path is known (the driver) and shipped to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load_tokenizer(json_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(json_text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_characters() -> list[str]:
    """The character in which byte-level vocabularies spell each byte: printable ones stand for themselves, the
    others follow from code point 256 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(x) if x in own else chr(next(rest)) for x in range(256)]


class WordMemo:
    """Ids of whole texts for a tokenizer that lower-cases, drops white space and marks the ends of pieces (``</w>``).

    Such a tokenizer never joins characters across ASCII white space, so a text's ids are those of its words one after
    the other; a worker encodes each word once and remembers its packed ids. Words of Latin letters, digits and marks are cut
    into the tokenizer's own pieces, which go to its model together, already normalised and spelt in bytes: each
    piece must give one end, else every word is encoded alone by the full tokenizer, as are all other words.
    """

    _kept: dict[str, WordMemo] = {}

    @classmethod
    def of(cls, json_text: str) -> WordMemo:
        """The memo of this Python worker, which outlives a task."""
        if json_text not in cls._kept:
            cls._kept.clear()
            cls._kept[json_text] = cls(json_text)
        return cls._kept[json_text]

    def __init__(self, json_text: str):
        self.full = load_tokenizer(json_text)
        bare = json.loads(json_text) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None,
                                        "added_tokens": []}
        self.model = load_tokenizer(json.dumps(bare))
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.spelt = byte_characters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _alone(self, words: list[bytes]) -> None:
        got = self.full.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.words.update((w, np.array(g.ids, "<u4").tobytes()) for w, g in zip(words, got))

    def _spell(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(map(self.spelt.__getitem__, piece.encode()))

    def _learn_pieces(self, pieces: list[str]) -> bool:
        """Whether every piece gave one end."""
        lines = [" ".join(map(self._spell, pieces[at:at + AT_ONCE])) for at in range(0, len(pieces), AT_ONCE)]
        ids = np.array([i for g in self.model.encode_batch_fast(lines, add_special_tokens=False) for i in g.ids], "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces) or (len(stops) and stops[-1] != len(ids)):
            return False
        packed, a = ids.tobytes(), 0
        for piece, z in zip(pieces, (stops * 4).tolist()):
            self.pieces[piece] = packed[a:z]
            a = z
        return True

    def learn(self, seen: set[bytes]) -> None:
        if len(self.words) > MEMO_WORDS:
            self.words, self.pieces = {}, {}
        cut, other = {}, []
        for w in seen.difference(self.words):
            low = w.decode().lower()
            latin = low.isascii() or (max(low) <= "\u024f" and all(c.isascii() or c.isalpha() for c in low))
            if not latin or "'" in low or "<|" in low or not low.isprintable():
                other.append(w)
            elif low.isalpha():
                cut[w] = low
            else:
                cut[w] = _PIECES.findall(low)
        new = {p for c in cut.values() for p in ((c,) if isinstance(c, str) else c)}.difference(self.pieces)
        if new and not self._learn_pieces(list(new)):
            other += cut
            cut = {}
        get = self.pieces.__getitem__
        for w, c in cut.items():
            self.words[w] = get(c) if isinstance(c, str) else b"".join(map(get, c))
        if other:
            self._alone(other)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed little-endian 32-bit numbers (null: empty)."""
        split = [(t or "").encode().split() for t in texts]  # bytes split at ASCII white space only
        self.learn(set().union(*split))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


class ByteCoder:
    """Ids of whole texts for a byte-level tokenizer, by a faster library with the ranks of the same file.

    Texts beyond Latin letters, where libraries may follow different versions of Unicode, are encoded by the full tokenizer.
    Strings of special tokens are special tokens.
    """

    _kept: dict[str, ByteCoder] = {}
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by the tokenizer
    _BEYOND = re.compile("[^\0-\u024f]")

    @classmethod
    def of(cls, json_text: str) -> ByteCoder:
        """The coder of this Python worker, which outlives a task."""
        if json_text not in cls._kept:
            cls._kept.clear()
            cls._kept[json_text] = cls(json_text)
        return cls._kept[json_text]

    def __init__(self, json_text: str):
        import tiktoken
        spec = json.loads(json_text)
        byte_of = {c: x for x, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.full = load_tokenizer(json_text)

    def encode(self, text: str | None) -> bytes:
        """The ids as packed little-endian 32-bit numbers (null: empty)."""
        if not text:
            return b""
        if not text.isascii() and self._BEYOND.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
