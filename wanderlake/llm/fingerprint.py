"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the hash's high bits choose one of the bins, the rest is its value,
and a bin keeps its least value. An empty bin takes the value of a bin found by probing with hashes of (bin,
attempt) alone until one is filled (optimal densification). Four low-order bits of each value, mixed with its bin's number, are
stored, packed and in base64: bins that share a borrowed value then still differ by themselves. Of two fingerprints, the share
of equal bins is corrected for bins equal by chance. A last byte marks texts without a word.

The next document is found in range partitions of the order (doc_id descending, nulls last, then text), in which each
task streams its sorted rows. The last row of a task waits for the first one of the next: these rows, two a task, meet in a second step.

Defined cases: a null text is empty; texts without a word share one fingerprint, which is like itself (1) and like no other (0); a text of
under five words is one shingle; equal texts have equal fingerprints; of rows equal in id and text any is the next one; other columns are
ignored; a lone document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import Scratch

BINS, BITS, SHINGLE = 512, 4, 5
#: Text bytes of a range of neighbours, and code points at the start of texts by which rows of one id are parted.
RANGE_BYTES, MOST_RANGES, PREFIX = 64 << 20, 1 << 16, 32
#: Texts whose bins are worked out at once, and code points of texts that are judged at once.
ROWS, CHARS = 64, 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STREAMED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("range", pa.int32()), ("edge", pa.string()), ("text", pa.string()),
])


def bins(texts: pa.Array, k: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(texts, k) bin values after densification, and which texts have any word."""
    word, at = tx.words(texts)
    h, owner = tx.shingles(word, at, SHINGLE)
    n = len(at) - 1
    out = np.full(n * k, _EMPTY)
    bin_of = (h >> np.uint64(64 - (k - 1).bit_length())).astype(np.int64)
    np.minimum.at(out, owner * k + bin_of, h & np.uint64((1 << 40) - 1))
    out = out.reshape(n, k)
    any_word = np.diff(at) > 0
    filled = out != _EMPTY
    row, col = np.nonzero(~filled & any_word[:, None])
    todo, attempt = np.arange(len(row)), 0
    while len(todo):
        probe = (tx.mix(col[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) % np.uint64(k)).astype(np.int64)
        good = filled[row[todo], probe]
        got = todo[good]
        out[row[got], col[got]] = out[row[got], probe[good]]
        todo, attempt = todo[~good], attempt + 1
    out[~any_word] = 0
    return out, any_word


def pack(values: np.ndarray, worded: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low-order bits of each bin, packed into bytes, and a byte that is 1 for texts without a word."""
    own = np.arange(values.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    low = tx.mix(values ^ own) & np.uint64((1 << bits) - 1)
    low[~worded] = 0
    planes = ((low[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.hstack([np.packbits(planes.reshape(len(low), -1), axis=1), (~worded)[:, None].astype(np.uint8)])


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(texts, BINS * BITS / 8 + 1) bytes."""
    return np.concatenate([pack(*bins(texts[i : i + ROWS])) for i in range(0, len(texts), ROWS)]) if len(texts) else np.zeros((0, BINS * BITS // 8 + 1), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of each pair of packed fingerprints, 0 to 1."""
    if not len(a):
        return np.zeros(0)
    x = np.unpackbits(a[:, :-1] ^ b[:, :-1], axis=1).reshape(len(a), -1, bits)
    same = (~x.any(axis=2)).mean(axis=1)
    chance = 0.5**bits
    out = np.clip((same - chance) / (1 - chance), 0, 1)
    blank_a, blank_b = a[:, -1] > 0, b[:, -1] > 0
    return np.where(blank_a | blank_b, (blank_a & blank_b).astype(float), out)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a task of the first step gives: rows with their digests in bytes, and its first and last document.
STREAMED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, range int, edge string, text string"
_JUDGED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def ranges(docs: DataFrame) -> DataFrame:
    """range, doc_id, text: rows in range partitions, sorted by doc_id (descending, nulls last) and text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("start", F.left("text", F.lit(PREFIX)))
    order = F.col("doc_id").desc_nulls_last()
    dealt = d.repartitionByRange(parts, order, "start").sortWithinPartitions(order, "text")
    return dealt.select(F.spark_partition_id().alias("range"), "doc_id", "text")


def _judge(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of each text. following: the next document's text; in a run of neighbours it is the next text itself."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    run = all(a is b for a, b in zip(texts[1:], following, strict=False))
    fp = fingerprints(pa.array([*texts, following[-1]] if run else [*texts, *following], pa.string()))
    n = len(texts)
    own, after = fp[:n], fp[1:] if run else fp[n:]
    changed = fingerprints(pa.array(edited, pa.string()))
    raw = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).digest() for e in edited], pa.binary()),
        raw(own), raw(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
    ]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a range but the last, judged with the row after it; and its first and last row as they are."""
    number, ids, texts, size = 0, [], [], 0

    def edge(name: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        own = {"doc_id": doc_id, "range": number, "edge": name, "text": text}
        return pa.RecordBatch.from_pylist([own], schema=_STREAMED)

    def judged() -> pa.RecordBatch:
        n = len(ids) - 1
        columns = _judge(ids[:-1], texts[:-1], texts[1:])
        return pa.RecordBatch.from_arrays([*columns, pa.array([number] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=_STREAMED)

    began = False
    for batch in batches:
        for number, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text")), strict=True):
            if not began:
                yield edge("first", doc_id, text)
                began = True
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if len(ids) > 1 and size >= CHARS:
                yield judged()
                ids, texts, size = ids[-1:], texts[-1:], len(text)
    if began:
        if len(ids) > 1:
            yield judged()
        yield edge("last", ids[-1], texts[-1])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            yield pa.RecordBatch.from_arrays(_judge([row["doc_id"]], [row["text"]], [row["next"]]), names=_JUDGED)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, and likeness to both that and the next document."""
    spark = docs.sparkSession
    made = Scratch(spark).save(ranges(docs).mapInArrow(_stream, STREAMED), "neighbours")
    edges = made.where("edge is not null").select("range", "edge", "doc_id", "text")
    used = [r[0] for r in edges.where("edge = 'first'").select("range").orderBy("range").collect()]  # an int a task
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "range int, after int")
    last = edges.where("edge = 'last'").join(F.broadcast(after), "range").select("doc_id", "text", "after")
    first = edges.where("edge = 'first'").select(F.col("range").alias("after"), F.col("text").alias("next"))
    met = last.join(first, "after").select("doc_id", "text", "next").mapInArrow(_meet, made.select(*_JUDGED).schema)
    plain = made.where("edge is null").select(*_JUDGED).unionByName(met)
    return plain.withColumns({"edited_sha256": F.lower(F.hex("edited_sha256")), **{c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")}})


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                fp = [base64.b64encode(x).decode() for x in fingerprints(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")
