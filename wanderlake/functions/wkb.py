"""Well-known binary geometries as segments, and polygons into it. Bytes go through Arrow batches; points are segments of no length."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
PARSED = "kind string, ring int, x1 double, y1 double, x2 double, y2 double"


def _parse(raw: bytes, at: int, out: list[tuple[str, np.ndarray]]) -> int:
    """Adds (kind, coordinates) of the geometry at a place in raw, and gives the place after it."""
    order = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    size = 2 + bool(code & HAS_Z) + bool(code & HAS_M)
    if code & HAS_SRID:
        at += 4
    code &= 0x0FFFFFFF
    size += (code // 1000 in (1, 3)) + (code // 1000 in (2, 3))
    kind = code % 1000

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        return n

    def points(n: int) -> np.ndarray:
        nonlocal at
        p = np.frombuffer(raw, order + "f8", n * size, at).reshape(n, size)[:, :2].astype(float)
        at += n * size * 8
        return p

    if kind == POINT:
        out.append(("point", points(1)))
    elif kind == LINE:
        out.append(("line", points(number())))
    elif kind == POLYGON:
        for _ in range(number()):
            out.append(("area", points(number())))
    elif kind in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION):
        for _ in range(number()):
            at = _parse(raw, at, out)
    else:
        raise ValueError(f"unknown geometry {code}")
    return at


def parse(raw: bytes | None) -> list[tuple[str, np.ndarray]]:
    """(kind, coordinates) of each point, line and ring; nothing for null, broken or empty geometries, or coordinates that are not finite."""
    out: list[tuple[str, np.ndarray]] = []
    try:
        _parse(bytes(raw or b""), 0, out)
    except (IndexError, struct.error, ValueError):
        return []
    out = [(k, p) for k, p in out if len(p)]
    return out if all(np.isfinite(p).all() for _, p in out) else []


def polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    """A polygon of rings of (x, y); rings are closed if they are not."""
    out = struct.pack("<BII", 1, POLYGON, len(rings))
    for r in rings:
        closed = r if r[0] == r[-1] else [*r, r[0]]
        out += struct.pack("<I", len(closed)) + np.asarray(closed, "<f8").tobytes()
    return out


def line(points: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, LINE, len(points)) + np.asarray(points, "<f8").tobytes()


def segments(geometries: DataFrame, key: str, wkb: str) -> DataFrame:
    """key, kind (point, line or area), ring (a number within the geometry), x1, y1, x2, y2 of every segment; rings are closed."""
    kind = dict(geometries.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A geometry a batch: one may have very many segments.
            for i, raw in enumerate(b.column(1).to_pylist()):
                for ring, (what, p) in enumerate(parse(raw)):
                    if what == "area" and (p[0] != p[-1]).any():
                        p = np.concatenate([p, p[:1]])
                    q = p if len(p) == 1 else p[1:]
                    p = p if len(p) == 1 else p[:-1]
                    n = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([b.column(0).slice(i, 1)] * n) if n < 64 else b.column(0).take(pa.array(np.full(n, i))), pa.array([what] * n), pa.array(np.full(n, ring, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in (p[:, 0], p[:, 1], q[:, 0], q[:, 1]))],
                        names=[key, "kind", "ring", "x1", "y1", "x2", "y2"],
                    )

    return geometries.select(F.col(key), F.col(wkb)).mapInArrow(run, f"`{key}` {kind}, {PARSED}")
