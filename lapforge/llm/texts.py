"""Vectorised words and shingles: hashes of all words of a batch of texts in a few numpy passes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is a difference of prefix sums
of a polynomial over random byte values, so no Python object is made per word. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)
_ROOT = 0x9E3779B97F4A7C15
_STATE: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(value: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([value & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def _byte_values(lower: bool) -> np.ndarray:
    key = ("bytes", lower)
    if key not in _STATE:
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))
        if lower:
            values[65:91] = values[97:123]
        _STATE[key] = values
    return _STATE[key]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the (odd) base and of its inverse modulo 2**64."""
    have = _STATE.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = pow(_ROOT, -1, 1 << 64)
        out = []
        for base in (_ROOT, inverse):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(base)
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 16 * CHUNK_BYTES:
            _STATE["powers"] = have
    return have


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets of the texts in them."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one text."""
    if not len(texts):
        return
    _, offsets = raw_bytes(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def split_words(data: np.ndarray, offsets: np.ndarray, extra: np.ndarray | None = None
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per text, the index of its first word (n + 1 values).

    ``extra``: a mask of further separator bytes.
    """
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    gap = ((data >= 9) & (data <= 13)) | (data == 32)
    if extra is not None:
        gap |= extra
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= gap[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values(lower)[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, per text, the index of its first word; ``lower`` folds A-Z only."""
    data, offsets = raw_bytes(texts)
    starts, ends, first = split_words(data, offsets)
    return span_hashes(data, starts, ends, lower), first


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` words in a row; with fewer words, of the whole sequence; of none, nothing."""
    n = len(words)
    if not n:
        return words
    if n < k:
        total = np.uint64(n)
        for w in words:
            total = total * np.uint64(_ROOT) + w
        return mix(np.array([total], dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = out * np.uint64(_ROOT) + words[j:n - k + 1 + j]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``k`` lower-cased words."""
    for a, b in chunks(texts):
        words, first = word_hashes(texts.slice(a, b - a))
        with np.errstate(over="ignore"):
            for i in range(b - a):
                yield np.unique(rolling(words[first[i]:first[i + 1]], k))
