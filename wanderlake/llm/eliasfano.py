"""Elias-Fano sequences in flat arrays that can be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
_ONE, _FULL = U64(1), U64(0xFFFFFFFFFFFFFFFF)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays on end behind a header, each at a multiple of eight bytes."""
    at, head, body = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, at, len(a))
        raw = a.tobytes()
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def unpack(data: np.ndarray) -> dict[str, np.ndarray]:
    """Views into the bytes of pack(), so a mapped file is read only where it is used."""
    n = int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8 : 8 + n]))
    return {name: data[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, at, size) in head.items()}


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers under 2^width on end, width (0 to 63) bits each."""
    out = np.zeros(len(values) * width // 64 + 2, U64)
    if width and len(values):
        bit = np.arange(len(values), dtype=U64) * U64(width)
        word, shift, v = (bit >> U64(6)).astype(np.int64), bit & U64(63), values.astype(U64)
        np.add.at(out, word, v << shift)
        np.add.at(out, word + 1, (v >> (U64(63) - shift)) >> _ONE)
    return out


def take_bits(packed: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U64)
    bit = i.astype(U64) * U64(width)
    word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
    return ((packed[word] >> shift) | ((packed[word + 1] << (U64(63) - shift)) << _ONE)) & U64((1 << width) - 1)


def encode(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """values: sorted, each under universe. About 2 + log2(universe / values) bits a value, and a directory."""
    n = len(values)
    low_bits = max(0, min(63, (universe // max(n, 1)).bit_length() - 1))
    v = values.astype(U64)
    low = pack_bits(v & U64((1 << low_bits) - 1), low_bits)
    top = (v >> U64(low_bits)).astype(np.int64)
    bits = top + np.arange(n)
    high = np.zeros((n + (universe >> low_bits) + 1) // 64 + 2, U64)
    np.add.at(high, bits >> 6, _ONE << (bits & 63).astype(U64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
    return {f"{name}.meta": np.array([n, low_bits], np.int64), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones}


_BYTES, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)
#: Place of the r-th set bit of each byte, at 256 * r + byte.
_IN_BYTE = np.zeros(8 * 256, np.int64)
for _byte in range(256):
    for _rank, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _IN_BYTE[256 * _rank + _byte] = _bit
#: Numbers that are looked up at once, so that the arrays between stay in a core's cache.
_BLOCK = 1 << 14


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word: the byte by running bit counts of all bytes at once, then the bit by a table."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), _BLOCK):
        w, rank = x[i : i + _BLOCK], k[i : i + _BLOCK].astype(U64)
        sums = np.bitwise_count(w.view(np.uint8)).view(U64) * _BYTES
        before = np.bitwise_count(((rank * _BYTES | _TOPS) - sums) & _TOPS).astype(U64) << U64(3)
        rank -= (sums << U64(8) >> before) & U64(255)
        out[i : i + _BLOCK] = before.astype(np.int64) + _IN_BYTE[(rank << U64(8) | (w >> before) & U64(255)).astype(np.int64)]
    return out


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = map(int, arrays[f"{name}.meta"])
        self.low, self.high, self.ones = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        return take_bits(self.low, i, self.low_bits)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.low_bits)) | self._low(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _in_word(self.high[word] ^ _FULL, k - self.zeros[word])

    def find(self, values: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each value between lo and hi, or -1: the successor search, and whether it hit."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        v = values.astype(U64)
        top = (v >> U64(self.low_bits)).astype(np.int64)
        most = len(self.high) * 64 - self.n - 1
        top = np.minimum(top, most)
        start = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1 - top, 0)
        end = self._zero(top) - top
        left, right = np.maximum(start, lo), end if hi is None else np.minimum(end, hi)
        want = v & U64((1 << self.low_bits) - 1)
        live = np.flatnonzero(left < right)
        last = right.copy()
        while len(live):
            mid = (left[live] + right[live]) >> 1
            less = self._low(mid) < want[live]
            left[live] = np.where(less, mid + 1, left[live])
            right[live] = np.where(less, right[live], mid)
            live = live[left[live] < right[live]]
        inside = np.flatnonzero(left < last)
        hit = inside[self._low(left[inside]) == want[inside]]
        out[hit] = left[hit]
        return out
