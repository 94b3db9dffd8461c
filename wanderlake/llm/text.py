"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased. The hash of a
word is taken from prefix sums of a polynomial over the whole buffer, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes and texts that are hashed at once (a longer single text is hashed alone): their arrays then stay in a core's cache.
CHUNK_BYTES, CHUNK_ROWS = 256 << 10, 4096
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
LONG = 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers 0..n; the tables grow by doubling and stay in the worker."""
    if len(_tables.get("up", ())) <= n:
        size = max(2 * CHUNK_BYTES, 1 << int(n + 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            t = np.full(size, base, U64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binary values) on end, and the n+1 offsets of each in them. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text and at most ``CHUNK_ROWS`` rows each; a longer text has a slice of its own."""
    _, off = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + CHUNK_ROWS)
        yield batch.slice(i, j - i)
        i = j


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n+1 offsets of each text's words."""
    solid = ~_SPACE[data]
    first = np.empty(len(data) + 1, bool)
    first[:-1] = solid
    first[-1] = False
    first[1:-1] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = solid[heads]
    start = np.flatnonzero(first)
    last = np.zeros(len(data) + 1, bool)
    last[1:] = solid
    last[1:-1] &= ~solid[1:]
    tails = off[1:][off[:-1] < off[1:]]
    last[tails] = solid[tails - 1]
    end = np.flatnonzero(last)
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans of over LONG bytes are hashed one by one: the polynomial is equal for some pairs of long spans."""
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    out = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n+1 offsets of each text's words."""
    data, off = buffers(texts)
    data = _LOWER[data]
    start, end, at = spans(data, off)
    return span_hashes(data, start, end), at


def shingles(word: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and each one's text. A text of 1 to k-1 words is one shingle."""
    n = np.diff(at)
    made = np.maximum(n - k + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), made)
    before = np.cumsum(made) - made
    pos = np.arange(len(owner)) - before[owner] + at[:-1][owner]
    h = np.zeros(len(owner), U64)
    for j in range(k):
        p = pos + j
        inside = p < at[1:][owner]
        w = word[np.minimum(p, len(word) - 1)] if len(word) else h
        h = h * U64(0x9FB21C651E98DF25) + np.where(inside, w, U64(0x5851F42D4C957F2D))
        h ^= h >> U64(29)
    return mix(h), owner
