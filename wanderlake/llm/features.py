"""Hashed text features for linear models, and the models' fitting.

A token is a run of letters (A-Z lower-cased, bytes over 127 count as letters), of digits (all alike), or of other
signs. Features are the distinct tokens of the whole text, hashed, and a few shares that describe its shape.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from . import text as tx

BUCKET_BITS = 22
DIM = 1 << BUCKET_BITS
SHAPE = ("upper", "digit", "sign", "line", "word_length", "repeated", "length")
_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sign
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens' buckets of each text in order, the n+1 offsets, and the shape of each text."""
    data, off = tx.buffers(texts)
    n = len(off) - 1
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[off] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(data))
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    low = tx._LOWER[data]
    low[kind == 2] = 48
    end_hashed = np.where(kind[start] == 2, start + 1, end) if len(start) else end
    h = tx.span_hashes(low, start, end_hashed)
    owner = np.repeat(np.arange(n), np.diff(np.searchsorted(start, off)))
    key = (owner.astype(np.uint64) << np.uint64(BUCKET_BITS)) | (h >> np.uint64(64 - BUCKET_BITS))
    distinct = np.unique(key)
    at = np.searchsorted(distinct >> np.uint64(BUCKET_BITS), np.arange(n + 1, dtype=np.uint64))
    size = np.maximum(np.diff(off), 1)
    def per_text(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[off[1:]] - total[off[:-1]]) / size

    made = np.bincount(owner, minlength=n)
    letters = np.bincount(owner, weights=end - start, minlength=n)
    shape = np.stack(
        [
            per_text((data >= 65) & (data <= 90)),
            per_text(kind == 2),
            per_text(kind == 3),
            per_text(data == 10) * 10,
            letters / np.maximum(made, 1) / 10,
            1 - np.diff(at) / np.maximum(made, 1),
            np.log1p(np.diff(off)) / 10,
        ],
        axis=1,
    )
    return (distinct & np.uint64(DIM - 1)).astype(np.int64), at, shape


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of bucket lists with a dense part. Buckets (under ``width``) and rows take four bytes each."""

    def __init__(self, bucket: np.ndarray, at: np.ndarray, dense: np.ndarray, row: np.ndarray | None = None, width: int = DIM):
        self.bucket, self.at, self.dense, self.width = bucket.astype(np.int32, copy=False), at, dense, width
        self.row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at)) if row is None else row

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.at)[rows]
        new_at = np.concatenate([[0], np.cumsum(n)])
        chosen = np.zeros(len(self), bool)
        chosen[rows] = True
        if len(rows) and np.all(np.diff(rows) > 0):
            return Sparse(self.bucket[chosen[self.row]], new_at, self.dense[rows], width=self.width)
        where = np.arange(int(n.sum())) - np.repeat(new_at[:-1], n) + np.repeat(self.at[rows], n)
        return Sparse(self.bucket[where], new_at, self.dense[rows], width=self.width)

    def with_dense(self, more: np.ndarray) -> Sparse:
        return Sparse(self.bucket, self.at, np.hstack([self.dense, more]), self.row, self.width)

    def compact(self) -> tuple[Sparse, np.ndarray]:
        """The same rows over only the buckets that several rows have, numbered on end, and these buckets: nothing is as wide as all buckets."""
        found, count = np.unique(self.bucket, return_counts=True)
        found = found[count > 1]
        place = np.minimum(np.searchsorted(found, self.bucket), max(len(found) - 1, 0))
        known = found[place] == self.bucket if len(found) else np.zeros(len(self.bucket), bool)
        kept = np.concatenate([[0], np.cumsum(known)])
        return Sparse(place[known], kept[self.at], self.dense, self.row[known], max(len(found), 1)), found


def gathered(batches: Iterable[pa.RecordBatch], tokens: str, dense: str, columns: int, others: list[str]) -> tuple[Sparse, list[np.ndarray]]:
    """The rows of batches with lists of buckets and of dense values in binary columns, straight from their buffers; and other columns."""
    buckets, sizes, values, rest = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros((0, columns))], [[np.zeros(0, np.int64)] for _ in others]
    for b in batches:
        data, off = tx.buffers(b.column(tokens))
        buckets.append(np.frombuffer(data.tobytes(), np.int32))
        sizes.append(np.diff(off) // 4)
        values.append(np.frombuffer(tx.buffers(b.column(dense))[0].tobytes()).reshape(b.num_rows, columns))
        for column, name in zip(rest, others, strict=True):
            column.append(np.asarray(b.column(name)))
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return Sparse(np.concatenate(buckets), at, np.concatenate(values)), [np.concatenate(c) for c in rest]


def as_rows(bucket: np.ndarray, at: np.ndarray, dense: np.ndarray) -> list[pa.Array]:
    """The binary columns that gathered() reads."""
    cells = lambda values, cuts: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
    return [cells(bucket.astype(np.int32), at * 4), cells(np.ascontiguousarray(dense, float), np.arange(len(dense) + 1) * dense.shape[1] * 8)]


class Linear:
    """Logistic regression over the buckets that tell the classes apart and the dense columns.

    A bucket is kept if its share in one class differs from that in the other by ``least_z`` standard errors; the
    rest only add noise that grows with a text's length.
    """

    def __init__(self, least_z: float = 5.0, most: int = 20_000, penalty: float = 1e-3, steps: int = 300):
        self.least_z, self.most, self.penalty, self.steps = least_z, most, penalty, steps

    def fit(self, x: Sparse, y: np.ndarray) -> Linear:
        y = y.astype(float)
        n1, n0 = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
        seen = np.bincount(x.bucket, minlength=x.width)
        used = np.flatnonzero(seen)
        seen = seen[used]
        in1 = np.bincount(x.bucket[(y > 0)[x.row]], minlength=x.width)[used]
        p = (seen + 1) / (n1 + n0 + 2)
        z = (in1 / n1 - (seen - in1) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        strong = np.flatnonzero(np.abs(z) >= self.least_z)
        self.kept = np.sort(used[strong[np.argsort(-np.abs(z[strong]), kind="stable")[: self.most]]]).astype(np.int32)
        self.mean = x.dense.mean(axis=0) if len(x) else np.zeros(x.dense.shape[1])
        self.scale = np.maximum(x.dense.std(axis=0), 1e-6) if len(x) else np.ones(x.dense.shape[1])
        weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(x) if 0 < y.sum() < len(y) else np.ones(len(y))
        row, col = self._columns(x)
        dense = (x.dense - self.mean) / self.scale
        d = len(self.kept) + dense.shape[1]
        w, b = np.zeros(d), 0.0
        m, v = np.zeros(d + 1), np.zeros(d + 1)
        for t in range(1, self.steps + 1):
            err = weight * (sigmoid(self._score(row, col, dense, w) + b) - y)
            g = np.concatenate([np.bincount(col, weights=err[row], minlength=len(self.kept)), dense.T @ err, [err.sum()]]) / max(len(x), 1)
            g[:-1] += self.penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, b
        return self

    def spread(self, buckets: np.ndarray) -> Linear:
        """The model for rows over all buckets, after a fit on compact ones."""
        self.kept = buckets[self.kept] if len(self.kept) else self.kept
        return self

    def _columns(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.kept) or not len(x.bucket):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        place = np.minimum(np.searchsorted(self.kept, x.bucket), len(self.kept) - 1).astype(np.int32)
        hit = self.kept[place] == x.bucket
        return x.row[hit], place[hit]

    def _score(self, row, col, dense, w) -> np.ndarray:
        return np.bincount(row, weights=w[col], minlength=len(dense)) + dense @ w[len(self.kept) :]

    def margin(self, x: Sparse) -> np.ndarray:
        row, col = self._columns(x)
        return self._score(row, col, (x.dense - self.mean) / self.scale, self.w) + self.b

    def predict(self, x: Sparse) -> np.ndarray:
        return sigmoid(self.margin(x))


class Platt:
    """Calibration: a logistic curve over margins, fitted by Newton steps with smoothed targets."""

    def fit(self, z: np.ndarray, y: np.ndarray) -> Platt:
        n1, n0 = y.sum(), (1 - y).sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * z + b)
            g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
            s = p * (1 - p) + 1e-6
            h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = a - step[0], b - step[1]
        self.a, self.b = max(a, 0.0), b
        return self

    def predict(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * z + self.b)


def best_threshold(p: np.ndarray, y: np.ndarray, share: float) -> float:
    """The cut with the best F1 if ``share`` of all rows are of class 1, between two scores. 0.5 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    weight = np.where(y[order] > 0, share / y.sum(), (1 - share) / (1 - y).sum())
    ps, hit = p[order], np.cumsum(weight * y[order])
    f1 = 2 * hit / (np.cumsum(weight) + share)
    last = np.append(ps[1:] != ps[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((ps[k] + ps[k + 1]) / 2) if k + 1 < len(ps) else float(ps[k])


def folds(ids: np.ndarray, n: int) -> np.ndarray:
    """A fold from the id alone, so copies of a row share it."""
    return (tx.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)
