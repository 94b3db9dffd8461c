"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 bits: a bit is set if it is set in over half of the XXH64 hashes of a text's three-word shingles, repeats included.
Texts are linked if their fingerprints differ in at most ``RADIUS`` bits, and a component is what can be reached by links.

Equal fingerprints are one node, so copies never meet. The nodes are cut into tiles: a tile's nodes have the same population counts in
each quarter of the fingerprint (at most 17^4 = 83,521 such cells), and a tile holds about ``TILE`` of them. Two fingerprints differ by at least the sum of
the differences of their quarters' counts, so a pair of tiles for which that sum is over the radius is skipped. All other pairs of tiles are compared
in full with exclusive-or and bit counts; nothing is sampled and no link is lost. A pair of tiles is one row, so pairs are dealt out evenly however
full a cell is. It gives the links of a spanning forest of what it finds, not each link, so a ball of fingerprints gives no square of links.

Defined cases: a null text is empty; a text without words has the fingerprint zero and is linked like any other; one of one or two words has the one
shingle of all its words; null ids take part and never name a component unless it has no other id; repeated rows each have a row; an
empty table gives no rows; other columns are ignored, whatever their names. Very long texts are hashed in chunks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .scratch import Scratch

WORDS, SEED, RADIUS, TILE = 3, 42, 3, 2048
PARTS, PART_BITS = 4, 16
#: Rows of a tile that are compared at once with all of another, so that the arrays between stay in a core's cache.
STRIP = 64
U64 = np.uint64


def shingle_spans(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all words with a space behind each, start and end of every shingle in them, and each one's text."""
    data, off = tx.buffers(texts)
    data = tx._LOWER[data]
    start, end, at = tx.spans(data, off)
    size = end - start
    # Every word moves to where the words before it, with a space each, end.
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[to + size] = False
    solid = np.zeros(len(data) + 1, np.int8)
    solid[start] = 1
    # A word may end where the next text's first begins.
    np.subtract.at(solid, end, 1)
    out[inside] = data[np.cumsum(solid[:-1]).astype(bool)]
    n = np.diff(at)
    made = np.maximum(n - words + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), made)
    first = np.arange(len(owner)) - (np.cumsum(made) - made)[owner] + at[:-1][owner]
    last = np.minimum(first + words, at[1:][owner]) - 1
    return out, to[first], to[last] + size[last], owner


def fingerprints(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    data, start, end, owner = shingle_spans(texts, words)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], seed) for a, b in zip(start.tolist(), end.tolist(), strict=True)], U64)
    n = np.bincount(owner, minlength=len(texts))
    out = np.zeros(len(texts), U64)
    some = np.flatnonzero(n)
    if len(some):
        first = (np.cumsum(n) - n)[some]
        for bit in range(64):
            ones = np.add.reduceat((h >> U64(bit) & U64(1)).astype(np.int64), first)
            out[some] |= (2 * ones > n[some]).astype(U64) << U64(bit)
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text")).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cell(fp: Column) -> Column:
    """The population counts of the quarters, as one number."""
    out = F.lit(0)
    for k in range(PARTS):
        out = out * (PART_BITS + 1) + F.bit_count(F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    return out


def _steps() -> list[list[int]]:
    """All differences of the quarters' counts that sum to at most the radius."""
    out = [[]]
    for _ in range(PARTS):
        out = [[*s, d] for s in out for d in range(-RADIUS, RADIUS + 1) if sum(map(abs, s)) + abs(d) <= RADIUS]
    return out


def tiles(nodes: DataFrame) -> DataFrame:
    """cell, sub, subs, fps binary: the tiles of different fingerprints (fp), and how many tiles their cell has."""
    own = nodes.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = own.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("subs"))
    # At most 83,521 cells.
    placed = own.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [np.asarray(x.values).astype(np.int64).tobytes() for x in b.column("list")]
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("sub"), b.column("subs"), pa.array(fps, pa.binary())], names=["cell", "sub", "subs", "fps"])

    lists = placed.groupBy("cell", "sub", "subs").agg(F.collect_list("fp").alias("list"))
    return lists.mapInArrow(run, "cell int, sub int, subs int, fps binary")


def near_tiles(cut: DataFrame) -> DataFrame:
    """a, b binary, same boolean: the pairs of tiles whose counts do not differ beyond the radius, each pair once."""
    sizes = cut.groupBy("cell").agg(F.first("subs").alias("far_subs")).select(F.col("cell").alias("far"), "far_subs")
    part = lambda c, k: F.floor(F.col(c) / (PART_BITS + 1) ** (PARTS - 1 - k)).cast("int") % (PART_BITS + 1)
    steps = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _steps()]))
    moved = cut.select("cell", "sub", steps.alias("step"))
    there = [part("cell", k) + F.col("step")[k] for k in range(PARTS)]
    valid = F.lit(True)
    far = F.lit(0)
    for t in there:
        valid = valid & t.between(0, PART_BITS)
        far = far * (PART_BITS + 1) + t
    # Which cells there are is at most 83,521 rows; each tile beyond the first of a cell is told by its number.
    pairs = moved.where(valid).select("cell", "sub", far.alias("far")).where("far >= cell").join(F.broadcast(sizes), "far")
    pairs = pairs.select("cell", "sub", "far", F.explode(F.sequence(F.lit(0), F.col("far_subs") - 1)).alias("far_sub")).where("far > cell or far_sub >= sub")
    left = cut.select("cell", "sub", F.col("fps").alias("a"))
    right = cut.select(F.col("cell").alias("far"), F.col("sub").alias("far_sub"), F.col("fps").alias("b"))
    return pairs.join(left, ["cell", "sub"]).join(right, ["far", "far_sub"]).select("a", "b", ((F.col("cell") == F.col("far")) & (F.col("sub") == F.col("far_sub"))).alias("same"))


def compare(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tiles (or one): each node that has a link and is not its group's least, with that least one."""
    values = a if same else np.concatenate([a, b])
    base = 0 if same else len(a)
    label = np.arange(len(values))
    for i in range(0, len(a), STRIP):
        rows, cols = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, i if same else 0 :]) <= RADIUS)
        x, y = rows + i, cols + base + (i if same else 0)
        # Hook the greater of two roots under the lesser, until all links of the strip are within a group.
        while len(x):
            p, q = label[x], label[y]
            live = p != q
            if not live.any():
                break
            x, y, p, q = x[live], y[live], p[live], q[live]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    apart = np.flatnonzero(label != np.arange(len(label)))
    return values[apart], values[label[apart]]


def links(pairs: DataFrame) -> DataFrame:
    """a, b long: links that connect whatever is within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [compare(np.frombuffer(a, U64), np.frombuffer(b, U64), same) for a, b, same in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "same")), strict=True)]
            ends = [np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(with_fingerprints(docs), "fingerprints")
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    cut = scratch.save(tiles(nodes), "tiles")
    labels = components(links(near_tiles(cut)), scratch, "fp-links")
    joined = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "label").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
