"""Vectorised word scanning of Arrow text batches, shared by the operators of this package.

A scan works on the UTF-8 bytes of a few documents at a time (`CHUNK_BYTES`), so its memory does
not grow with the batch; one document longer than that is scanned alone. Words are runs of bytes of
a class, ASCII upper case counts as lower case, and a word is known by a 64-bit hash of its bytes.
All bytes of non-ASCII characters are >= 0x80, so byte classes express both word rules in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
SHINGLE = 5

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Byte values for words whose letters keep their case.
CASED = _TABLE.copy()
for _c in range(65, 91):  # A-Z count as a-z
    _TABLE[_c] = _TABLE[_c + 32]
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters and all non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.full(size, np.uint64(base), np.uint64)
        p[0] = 1
        got = np.multiply.accumulate(p)
        if size <= 4 * CHUNK_BYTES:  # tables for one very long document are not kept
            _powers[base] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Chunk:
    """Some documents of a batch. Word arrays are in text order over all of them."""
    rows: range            # the documents' positions in the batch
    data: np.ndarray       # their bytes
    offsets: np.ndarray    # document boundaries in data (len(rows) + 1)
    start: np.ndarray      # byte where each word begins
    words: np.ndarray      # uint64 hash of each word
    bounds: np.ndarray     # word index where each document begins (len(rows) + 1)
    prefixes: list[np.ndarray]  # per asked length: hash of each word's first bytes, 0 for shorter words


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_scan(data: np.ndarray, offsets: np.ndarray, word_class: np.ndarray, prefixes: tuple[int, ...] = (),
              table: np.ndarray = _TABLE) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start byte, hash, hashes of the first bytes) of the words of the documents laid out in data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes]
    inside = word_class[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside
    begins[1:] &= ~inside[:-1] | edge[1:n]
    start = np.flatnonzero(begins)
    begins[:] = ends
    begins[:-1] &= ~inside[1:] | edge[1:n]
    end = np.flatnonzero(begins) + 1
    value = table[data]
    value *= _power(_BASE, n)[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    inverse = _power(_BASE_INV, n)[start]
    words = mix((total[end] - total[start]) * inverse)
    heads = [np.where(end - start >= k, mix((total[np.minimum(start + k, n)] - total[start]) * inverse + np.uint64(k)), np.uint64(0))
             for k in prefixes]
    return start, words, heads


def chunks(column: pa.Array, word_class: np.ndarray, prefixes: tuple[int, ...] = (), table: np.ndarray = _TABLE) -> Iterator[Chunk]:
    """The documents of a text column, as scanned chunks in order."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        part, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        start, words, heads = word_scan(part, off, word_class, prefixes, table)
        yield Chunk(range(i, j), part, off, start, words, np.searchsorted(start, off), heads)
        i = j


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (none if there are fewer)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m] * _COEF[0]
    for j in range(1, k):
        h += words[j:j + m] * (_COEF[j] if j < 64 else mix(_COEF[j % 64] + np.uint64(j)) | np.uint64(1))
    return mix(h + np.uint64(k))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles; with fewer words, of the whole sequence; none without words."""
    return grams(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingles(words))


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return np.ascontiguousarray(h).view(np.int64)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """list<int64> from uint64 or int64 arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64, copy=False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
