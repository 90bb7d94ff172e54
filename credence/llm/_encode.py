"""Token ids of whole texts with the ``tokenizers`` library, each distinct word encoded once.

A tokenizer that drops white space and never merges across it gives a text the concatenated ids of
its words. This is checked when the file is loaded; any other tokenizer encodes whole texts. Words
are looked up by a 64-bit hash in a sorted table per Python worker, and a second, independent hash of
every word must agree (else the chunk's texts are encoded whole); only words not seen before reach
the library. The table is emptied when it holds ``MAX_WORDS`` words, which bounds memory and changes
no result.
"""

from __future__ import annotations

import os

import numpy as np

from credence.llm import _text

MAX_WORDS = 3_000_000
_SAMPLES = ["The quick, brown fox! can't stop... 12,345 Étés ### tokeń = \"a-b\"", "a b c 'll x's ,, 中文 d'e <|x|>"]
_JOIN = 64  # words encoded as one text


class Encoder:
    def __init__(self, path: str, offsets: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        self.offsets = offsets
        one = self._ids
        self.by_word = all(one(s) == [i for w in s.split() for i in one(w)] for s in _SAMPLES)
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.check = np.zeros(0, np.uint64)
        self.flat = np.zeros(0, np.uint32)
        self.span = np.zeros((0, 2), np.int32)

    def _encode_words(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids per word, character spans inside the word)."""
        groups = [b" ".join(ws[i : i + _JOIN]).decode() for i in range(0, len(ws), _JOIN)]
        ids, counts, spans = [], [], []
        for text, enc in zip(groups, self.lib.encode_batch(groups, add_special_tokens=False), strict=True):
            got = text.split(" ")
            lengths = np.fromiter(map(len, got), np.int64, len(got)) + 1
            base = np.cumsum(lengths) - lengths
            span = np.array(enc.offsets, np.int64).reshape(-1, 2)
            owner = np.searchsorted(base, span[:, 0], "right") - 1
            ids.append(np.array(enc.ids, np.uint32))
            counts.append(np.bincount(owner, minlength=len(got)))
            if self.offsets:
                spans.append((span - base[owner][:, None]).astype(np.int32))
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)

    def _find(self, keys: np.ndarray, checks: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of sorted distinct word hashes; unknown words are encoded and kept."""
        if len(self.keys) > MAX_WORDS:
            self._reset()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            body = memoryview(data.tobytes())
            flat, counts, span = self._encode_words([bytes(body[s:e]) for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            slots = len(self.count) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.check = np.concatenate([self.check, checks[new]])
            self.flat = np.concatenate([self.flat, flat])
            if self.offsets:
                self.span = np.concatenate([self.span, span])
            self.slots = np.insert(self.slots, at[new], slots)
            self.keys = np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return self.slots[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets of the documents in them)."""
        ids, first, _ = self.encode_spans(data, offsets, spans=False)
        return ids, first

    def encode_spans(self, data: np.ndarray, offsets: np.ndarray, spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Also the tokens' character spans, counted from the start of the chunk."""
        if not self.by_word:
            return self._whole(data, offsets, spans)
        starts, ends, first = _text.words(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.zeros((0, 2), np.int64)
        keys, at, inverse = np.unique(_text.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        checks = _text.word_hashes(data, starts, ends, seed=1)
        slot = self._find(keys, checks[at], data, starts[at], ends[at])[inverse]
        if (self.check[slot] != checks).any():  # two words with one hash, told apart by the other
            return self._whole(data, offsets, spans)
        n = self.count[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        pick = _text.ranges(self.begin[slot], n)
        where = np.zeros((0, 2), np.int64)
        if spans:
            chars = char_index(data)
            where = self.span[pick].astype(np.int64) + np.repeat(chars[starts], n)[:, None]
        return self.flat[pick], total[first], where

    def _whole(self, data: np.ndarray, offsets: np.ndarray, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        body = data.tobytes()
        texts = [body[s:e].decode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        got = self.lib.encode_batch(texts, add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in got]
        first = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        where = np.zeros((0, 2), np.int64)
        if spans and len(got):
            base = char_index(data)[offsets[:-1]]
            where = np.concatenate([np.array(e.offsets, np.int64).reshape(-1, 2) + b for e, b in zip(got, base, strict=True)])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), first, where


def char_index(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte position (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


_loaded: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, offsets: bool = False) -> Encoder:
    """One encoder per Python worker, file and kind."""
    if (path, offsets) not in _loaded:
        _loaded[path, offsets] = Encoder(path, offsets)
    return _loaded[path, offsets]
