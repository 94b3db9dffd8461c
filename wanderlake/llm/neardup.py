"""Near-duplicates by ProbMinHash over weighted five-word shingles.

A shingle's weight is its count in the text. It arrives at the registers as a Poisson process of that rate, each
arrival at a register drawn by hash; a register keeps the first arrival. A shingle is dropped as soon as its
next arrival is later than the latest register. Two texts share a register's winner with
the probability of their probability Jaccard similarity. Registers are banded; texts that share a band are
candidates, and are verified by their exact similarity over whole texts.

Equal texts are one node from the start. In a bucket of a band, every member is tested against the one that shares
most buckets with others, so a bucket of n texts makes n - 1 pairs. Once components are known, only buckets that still hold
several components are looked at again. Their texts would make very many pairs where a large family is only partly
alike, so pairs that provably fail are left out first: probability Jaccard is at most 1 / (1/m + 1/n - 1), where m and n
are the shares of each text's weight that lie on common shingles; for 0.8 both must be 0.8 at least. In one order of all
shingles (rare ones first), the first common shingle then lies among either text's first ones, and what lies
before it isn't common. A small bitmap of each text's shingles counts more that aren't: a bit that only one text
has is a shingle that only it has. Texts of different components that meet in such a shingle and may reach 0.8 by both
bounds are tested, so no link between components stays untested.

Defined cases: a null text is empty; texts without a word are copies of each other only if equal; a text of under
five words is one shingle; rows are compared by their texts alone, so those that share an id but no text (null ids, too) stay apart; the
class of texts that have only null ids is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components, with_group
from .scratch import Scratch

SHINGLE, BANDS, ROWS, LEAST = 5, 32, 6, 0.8
#: Pairs whose estimate is more than five standard errors under the threshold aren't verified.
LEAST_ESTIMATE = LEAST - 5 * (LEAST * (1 - LEAST) / (BANDS * ROWS)) ** 0.5
#: Ids that may be broadcast (16 MB); beyond, texts and ids meet in a shuffle.
IDS_BROADCAST = 1_000_000
#: Cells of the table that tells rare shingles from frequent ones (4 bytes a cell, sent to every task). Shingles that share a cell only blur the order.
RARITY_CELLS = 1 << 20
#: 64-bit words of a text's bitmap.
WORDS = 16
MAP = [f"m{k}" for k in range(WORDS)]
U64 = np.uint64


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text: text, hash, count, sorted; and the number of texts."""
    word, at = tx.words(texts)
    h, owner = tx.shingles(word, at, SHINGLE)
    if len(at) - 1 > tx.CHUNK_ROWS:
        raise ValueError("at most 4,096 texts at once")
    key = np.sort((owner.astype(U64) << U64(52)) | (h >> U64(12)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(52)).astype(np.int64), key & U64((1 << 52) - 1), count, len(at) - 1


def signatures(texts: pa.Array, m: int = BANDS * ROWS) -> np.ndarray:
    """(texts, m) winners. A text without shingles has zeros."""
    owner, shingle, count, n = weighted(texts)
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, U64)
    t, live, k = np.zeros(len(owner)), np.arange(len(owner)), 0
    latest = np.full(n, np.inf)
    while len(live):
        k += 1
        draw = tx.mix(shingle[live] + U64(k * 0x9E3779B97F4A7C15 % 2**64))
        t[live] -= np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / count[live]
        live = live[t[live] < latest[owner[live]]]
        draw = tx.mix(shingle[live] * U64(0xA0761D6478BD642F) + U64(k))
        cell = owner[live] * m + (draw % U64(m)).astype(np.int64)
        np.minimum.at(first, cell, t[live])
        won = t[live] == first[cell]
        winner[cell[won]] = shingle[live[won]]
        touched = np.unique(owner[live])
        latest[touched] = first.reshape(n, m)[touched].max(axis=1)
        live = live[t[live] < latest[owner[live]]]
    return tx.mix(winner).reshape(n, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate([[0.0], np.cumsum(x)])
    above = y.sum() - np.concatenate([[0.0], np.cumsum(y)])
    both = np.flatnonzero((x > 0) & (y > 0))
    upto = np.searchsorted(ratio, ratio[both], "right")
    return float((1 / (below[upto] / x[both] + above[upto] / y[both])).sum())


SKETCH = "id long, same binary, low binary, bands array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """For every row: id, the digest of the whole text, the registers' low bytes, and a key for each band (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, ROWS + 1, dtype=U64) * U64(0xE7037ED1A0B428DB)
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                texts = b.column("text")
                sig = signatures(texts)
                band = tx.mix((tx.mix(sig.reshape(len(sig), BANDS, ROWS) + salt)).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0x8EBC6AF09C88C6E3))
                worded = np.diff(tx.words(texts)[1]) > 0 if len(sig) else np.zeros(0, bool)
                keys = band.astype(np.int64) if len(sig) else np.zeros((0, BANDS), np.int64)
                at = np.concatenate([[0], np.cumsum(worded * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"),
                        b.column("same"),
                        pa.array([(s & U64(255)).astype(np.uint8).tobytes() for s in sig], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys[worded].reshape(-1))),
                    ],
                    names=["id", "same", "low", "bands"],
                )

    return _texts(docs).mapInArrow(run, SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text)).alias("same"), text.alias("text"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= IDS_BROADCAST else df


def _texts_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """ids (id and other columns) with their texts, each read from a row of the text's least doc_id."""
    wanted = scratch.save(nodes.select("id", "same", "least").join(ids, "id"), f"{name}-ids").withColumnRenamed("same", "digest")
    texts = _texts(docs).withColumnRenamed("id", "doc_id")
    found = texts.join(_small(wanted, wanted.count()), (F.col("same") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("least")))
    return scratch.save(found.select(*ids.columns, "text").dropDuplicates(["id"]), name)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity reaches the threshold, with it."""
    low = nodes.select("id", "low")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("low_a", "low_b"))
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield b.select(["a", "b"]).filter(pa.array(same >= LEAST_ESTIMATE))

    with_low = pairs.join(low.withColumnsRenamed({"id": "a", "low": "low_a"}), "a").join(low.withColumnsRenamed({"id": "b", "low": "low_b"}), "b")
    close = scratch.save(with_low.select("a", "b", "low_a", "low_b").mapInArrow(likely, "a long, b long"), f"{name}-close")
    ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = _texts_of(docs, nodes, ids, scratch, f"{name}-texts")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tx.chunks(batch, "text_a", tx.CHUNK_BYTES // 4):
                sets = []
                for c in ("text_a", "text_b"):
                    owner, shingle, count, n = weighted(b.column(c))
                    at = np.searchsorted(owner, np.arange(n + 1))
                    sets.append([(shingle[at[i] : at[i + 1]], count[at[i] : at[i + 1]]) for i in range(n)])
                s = np.array([similarity(x, y) for x, y in zip(*sets, strict=True)])
                out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
                yield out.filter(pa.array(s >= LEAST - 1e-12, pa.bool_()))

    texts = close.join(needed.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(needed.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    out = scratch.save(texts.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long, similarity double"), f"{name}-links")
    scratch.drop(f"{name}-texts")
    scratch.drop(f"{name}-close")
    return out


def rarity(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each cell. Tasks count on their own, so the shuffle has at most one row a cell and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_CELLS, np.int64)
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                total += np.bincount((weighted(b.column("text"))[1] % U64(RARITY_CELLS)).astype(np.int64), minlength=RARITY_CELLS)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + (1 << 16)]), pa.array(total[used[i : i + (1 << 16)]])], names=["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY_CELLS, np.uint32)
    out[found.column("cell").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    return out


def heads(texts: DataFrame) -> DataFrame:
    """The rare shingles at the head of every text: id, label, shingle, weight before it, least weight of a shingle, bitmap of all shingles.

    Shingles that no other text holds are left out.
    """
    seen = rarity(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                owner, shingle, count, n = weighted(b.column("text"))
                rare = seen[(shingle % U64(RARITY_CELLS)).astype(np.int64)]
                order = np.lexsort((shingle, rare, owner))
                owner, shingle, rare = owner[order], shingle[order], rare[order]
                share = count[order] / np.bincount(owner, count[order], n)[owner]
                before = np.cumsum(share) - share
                before -= before[np.searchsorted(owner, np.arange(n))[owner]] if len(owner) else 0.0
                unit, bitmap = np.ones(n), np.zeros((n, WORDS), U64)
                np.minimum.at(unit, owner, share)
                bit = tx.mix(shingle)
                np.bitwise_or.at(bitmap, (owner, ((bit >> U64(6)) % U64(WORDS)).astype(np.int64)), U64(1) << (bit & U64(63)))
                keep = (before <= 1 - LEAST + 1e-6) & (rare > 1)
                at, held = pa.array(owner[keep]), bitmap[owner[keep]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("label").take(at), pa.array(shingle[keep].astype(np.int64)), pa.array(before[keep]), pa.array(unit[owner[keep]]), *[pa.array(held[:, k]) for k in range(WORDS)]],
                    names=["id", "label", "shingle", "before", "unit", *MAP],
                )

    return texts.select("id", "label", "text").mapInArrow(run, "id long, label long, shingle long, before double, unit double, " + ", ".join(f"{m} long" for m in MAP))


def may_link(head: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different labels that meet in a shingle of their heads and may reach the threshold by both bounds."""
    x, y = head.alias("x"), head.alias("y")
    alone = lambda p, q: sum(F.bit_count(F.col(f"{p}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{q}.{m}")))) for m in MAP) * F.col(f"{p}.unit")
    shared = lambda p, q: 1 + 1e-6 - F.greatest(F.col(f"{p}.before"), alone(p, q))
    near = (1 / shared("x", "y") + 1 / shared("y", "x")) <= 1 + 1 / LEAST
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & near
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _labelled(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, same, label for every row: rows of one label are near-duplicates of each other."""
    sketch = scratch.save(sketches(docs), "sketch")
    one = sketch.groupBy("same").agg(F.min("id").alias("least"), F.first("low").alias("low"), F.first("bands").alias("bands"))
    # Numbers from places in a table that is written at once, so that they hold.
    nodes = scratch.save(one.withColumn("id", F.monotonically_increasing_id()), "nodes")

    keys = nodes.select("id", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(keys.join(buckets, "key"), "shared")
    # The text that others centre on shares more bands with them than they do with each other, so it is the best one to test against.
    degree = shared.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    central = shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("c")).select("key", (-F.col("c.minus")).alias("centre"))
    first = shared.join(central, "key").where("id <> centre").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))
    first = scratch.save(first.distinct(), "first")
    links = verified(first, nodes, docs, scratch, "one")
    labels = components(links, scratch, "round-one")

    labelled = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = sizes.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1")
    open_ids = scratch.save(labelled.join(open_keys.select("key"), "key").select("id", "label").distinct(), "open")
    head = scratch.save(heads(_texts_of(docs, nodes, open_ids, scratch, "open-texts")), "heads")
    # Shingles that only one component holds can't link two.
    across = head.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
    again = may_link(head.join(across, "shingle"))
    more = verified(again.join(first, ["a", "b"], "left_anti"), nodes, docs, scratch, "two")
    # Only labels of the first round that the second one links are joined again.
    label_of = lambda c: open_ids.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    pairs = more.select("a", "b").join(label_of("a"), "a").join(label_of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    tied = components(pairs, scratch, "round-two").select(F.col("node").alias("label"), F.col("label").alias("final"))
    numbers = nodes.select("id", "same").join(labels.withColumnRenamed("node", "id"), "id", "left").select("same", F.coalesce("label", "id").alias("label"))
    labels = numbers.join(tied, "label", "left").select("same", F.coalesce("final", "label").alias("label"))
    for name in ("shared", "first", "open-texts", "heads"):
        scratch.drop(name)
    return sketch.select("id", "same").join(labels, "same").select("id", "same", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of its group of near-duplicates) for every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_labelled(docs, scratch), "labelled")
    least = rows.groupBy(F.col("label").alias("a")).agg(F.count("*").alias("n"), F.min("id").alias("m"))
    found = with_group(rows.withColumnRenamed("label", "a"), least, rows.count())
    return found.select(F.col("id").alias("doc_id"), F.col("m").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, one of its least id, with the columns it came with."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_labelled(docs, scratch).groupBy("label", "id", "same").agg(F.count("*").alias("n")), "labelled")
    order = lambda: F.struct(F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("least"), F.col("same").alias("digest"))
    best = rows.groupBy("label").agg(F.min(order()).alias("best"))
    first = best.select(F.when(~F.col("best.last"), F.col("best.least")).alias("id"), F.col("best.digest").alias("digest"))
    # By id and text, not by label: a class with very many rows is then no hot key.
    is_first = lambda: rows.id.eqNullSafe(first.id) & (rows.same == first.digest)
    gone = scratch.save(rows.join(first, is_first(), "left_anti").select("id", F.col("same").alias("digest")), "gone")
    repeated = scratch.save(rows.where("n > 1").join(first, is_first(), "left_semi").select("id", F.col("same").alias("digest")), "repeated")
    n_repeated = repeated.count()
    digest = F.unhex(F.md5(F.coalesce(docs.text, F.lit(""))))
    is_in = lambda df: docs.doc_id.cast("long").eqNullSafe(df.id) & (digest == df.digest)
    kept = docs.join(_small(gone, gone.count()), is_in(gone), "left_anti")
    if not n_repeated:
        return kept
    once = kept.join(_small(repeated, n_repeated), is_in(repeated), "left_anti")
    several = kept.join(_small(repeated, n_repeated), is_in(repeated), "left_semi")
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))
