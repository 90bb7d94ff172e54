"""Whole texts of an Arrow batch as byte arrays: words, word hashes, hashes of word runs.

All work is vectorised over a chunk of documents of bounded size (one longer document is a chunk of
its own). Words are hashed eight bytes at a time by a non-linear mixer. Runs of words are hashed by
polynomial sums over the words' hashes, taken as differences of prefix sums, so each costs one
subtraction and one multiplication; runs are short (at most a window), too short for the repeating
words on which such sums modulo 2**64 collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (the public splitmix64 rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes with A-Z as a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Odd multipliers by seed (the fractional parts of the square roots of 2 and 3, made odd).
_STEP = (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)
LONG_WORD = 64

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and its inverse for i < n, kept between calls up to a few chunks' length."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    both = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if n <= 2 * CHUNK_BYTES:
        _powers[:] = both
    return both[0], both[1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets); null counts as empty."""
    a = texts.cast(pa.large_binary()).fill_null(b"")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    body = a.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text", max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text, but at least one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(text_col))
        ends = utf8(texts)[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of word bytes inside each document, and the index
    of each document's first word (one more entry than documents)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word; ``fold`` takes A-Z as a-z; hashes of different seeds are independent.

    Eight bytes at a time pass through the (bijective, non-linear) finaliser, so equally long words of
    up to eight bytes never collide; words over ``LONG_WORD`` bytes take a keyed BLAKE2 hash."""
    if fold:
        data = _FOLD[data]
    size = ends - starts
    h = mix((size.astype(np.uint64) + np.uint64(1 + 2 * seed)) * np.uint64(MULTIPLIER))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        left = size[live] - at
        lane = lanes[starts[live] + at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        h[live] = mix((h[live] ^ lane) * np.uint64(_STEP[seed]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        body = data[starts[i] : ends[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(body, digest_size=8, key=bytes([1 + seed])).digest(), "little")
    return h


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position i <= len - k (document limits are the
    caller's concern)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _pow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
