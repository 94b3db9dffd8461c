"""Phrases (collocations) from an FM-index per shard.

Texts are cut into pieces at punctuation and line ends, and pieces into words. A shard is up to ``SHARD_BYTES`` of one language's texts in one task. Its
words are numbered, its pieces stand on end with a separator between, and two Burrows-Wheeler transforms are made: of the words and of the words reversed.
Suffixes are sorted by their first ``DEPTH`` words only, which is enough for the intervals of phrases of up to that length; ties keep their order.
A phrase is a pair of intervals. Its right extensions are the words in its interval of the reversed transform, its left extensions those in its
interval of the other; either step moves one interval by the rank of the word and the other by how many extensions are less. So words become pairs by
right extension and pairs become triples by left extension, all intervals of a level at once, each with its count and with how many of its
occurrences a word stands before and after. Separators are never extended.

The shards' numbers are added up by phrase, dealt out by a hash of the phrase: one row for each shard and part, the phrases in it on end. A phrase that
stands in every text is one entry a shard, so nothing is skewed. Only sums below the least count are dropped, after all shards are added.

Defined cases: a null text is empty, a null language is ``und``; pieces without words count nothing; overlapping occurrences count (``a a a`` has
``a a`` twice); repeated rows count as often as they stand; equal scores go by count, then by the bytes of the phrase; a language without candidates gives no rows, nor does an empty
table; other columns are ignored, whatever their names. A very long text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import Scratch

DEPTH, LEAST, MOST, COVERED = 3, 10, 2000, 50
SHARD_BYTES, PART_BYTES, MOST_PARTS = 3 << 20, 8 << 20, 1 << 15
U64 = np.uint64
#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Shard:
    """The words of some texts: their bytes with a space behind each, where each starts, and the numbered words of all pieces with 0 between."""

    def __init__(self, texts: pa.Array):
        data, off = tx.buffers(texts)
        data = tx._LOWER[data]
        kind = np.append(_KIND[data], np.int8(2))
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        solid = kind == 0
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:]
        start = np.flatnonzero(first)
        stop = np.flatnonzero(~solid[1:] & solid[:-1] | edge[1:] & solid[:-1]) + 1
        self.n_words = len(start)
        size = stop - start
        self.size = size
        self.start = np.cumsum(size + 1) - size - 1
        self.bytes = np.full(int((size + 1).sum()), 0x20, np.uint8)
        inside = np.ones(len(self.bytes), bool)
        inside[self.start + size] = False
        self.bytes[inside] = data[solid[:-1]]
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(self.start, len(self.bytes)).astype(np.int64)), pa.py_buffer(self.bytes)]).dictionary_encode()
        ids = np.asarray(found.indices).astype(np.int64) + 1 if len(start) else np.zeros(0, np.int64)
        self.v = len(found.dictionary) + 1
        word, word_off = tx.buffers(found.dictionary)
        self.hash = np.append(U64(0), tx.span_hashes(word, word_off[:-1], word_off[1:]))
        # A piece begins with the first word of a text, and after a byte between pieces.
        breaks = np.cumsum((kind == 2) | edge)
        new = np.append(True, breaks[start[1:]] != breaks[start[:-1]]) if len(start) else np.zeros(0, bool)
        at = np.arange(len(ids)) + np.cumsum(new)
        self.text = np.zeros(len(ids) + int(new.sum()) + 1, np.int64)
        self.text[at] = ids
        #: Which word stands at each place of the text.
        self.word = np.zeros(len(self.text), np.int64)
        self.word[at] = np.arange(len(ids))


class Index:
    """The transform of a text of numbers under v, 0 between pieces: suffixes sorted by their first words, and the number before each."""

    def __init__(self, text: np.ndarray, v: int, depth: int):
        key, live = text.copy(), text != 0
        for k in range(1, depth):
            if (int(key.max(initial=0)) + 1) * v >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            after = np.where(live, np.roll(text, -k), 0)
            live = after != 0
            key = key * v + after
        self.n, self.suffix = len(text), np.argsort(key, kind="stable")
        self.bwt = text[self.suffix - 1]
        #: All (number, row) in order: a search in it is the count of lesser numbers and the rank of a number before a row at once.
        self.ranked = np.sort(self.bwt * self.n + np.arange(self.n))
        self.less = np.searchsorted(self.ranked, np.arange(v + 1) * self.n)
        self.words = np.concatenate([[0], np.cumsum(self.bwt != 0)])

    def step(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the interval of number + phrase begins, if the phrase's begins at row."""
        return np.searchsorted(self.ranked, number * self.n + row)

    def extended(self, lo: np.ndarray, count: np.ndarray, v: int) -> tuple[np.ndarray, ...]:
        """For each interval and number before its rows: interval, number, how many, and how many lesser ones before; none for separators."""
        which = np.repeat(np.arange(len(lo)), count)
        row = np.arange(len(which)) - (np.cumsum(count) - count)[which] + lo[which]
        found, n = np.unique(which * v + self.bwt[row], return_counts=True)
        before = np.cumsum(n) - n
        which, number = found // v, found % v
        before -= (np.cumsum(count) - count)[which]
        own = number != 0
        return which[own], number[own], n[own], before[own]


def enumerate_phrases(shard: Shard, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, ...]]:
    """By length: first place in the text, count, and the occurrences with a word before and with one after, of each phrase."""
    v = shard.v
    ahead, back = Index(shard.text, v, depth), Index(shard.text[::-1].copy(), v, depth)
    number = np.arange(1, v)
    lo, count = ahead.less[number], np.diff(ahead.less)[number]
    rlo = lo.copy()
    for k in range(1, depth + 1):
        within = lambda index, start: index.words[start + count] - index.words[start]  # noqa: B023, E731
        yield ahead.suffix[lo], count, within(ahead, lo), within(back, rlo)
        if k == depth:
            return
        if k % 2:
            which, number, n, before = back.extended(rlo, count, v)
            lo, rlo, count = lo[which] + before, back.step(number, rlo[which]), n
        else:
            which, number, n, before = ahead.extended(lo, count, v)
            lo, rlo, count = ahead.step(number, lo[which]), rlo[which] + before, n


COUNTED = "part int, lang string, phrases binary, numbers binary"
SUMS = "lang string, phrase string, words int, n long, before long, after long"


def _parts(shard: Shard, parts: int, depth: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each part: its phrases, a line feed behind each, and count, before and after of each as byte planes."""
    start, stop, hashes, numbers = [], [], [], []
    for k, (place, *found) in enumerate(enumerate_phrases(shard, depth)):
        h = np.zeros(len(place), U64)
        for j in range(k + 1):
            h = tx.mix(h * U64(0x9FB21C651E98DF25) + shard.hash[shard.text[place + j]])
        word = shard.word[place]
        start.append(shard.start[word])
        stop.append(shard.start[word + k] + shard.size[word + k])
        hashes.append(h)
        numbers.append(np.stack(found).astype(np.uint32))
    start, stop, part, numbers = np.concatenate(start), np.concatenate(stop), (np.concatenate(hashes) % U64(parts)).astype(np.int16), np.concatenate(numbers, axis=1)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        own = order[cut[p] : cut[p + 1]]
        size = stop[own] - start[own] + 1
        end = np.cumsum(size)
        out = shard.bytes[np.arange(int(end[-1])) + np.repeat(start[own] - end + size, size)]
        out[end - 1] = 0x0A
        yield p, out.tobytes(), np.ascontiguousarray(numbers[:, own].reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes()


def _lines(blob: bytes) -> pa.Array:
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends + 1).astype(np.int64)), pa.py_buffer(blob)])


def counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, n, before, after of every phrase of up to depth words that occurs least times or more; the empty phrase has a language's number of words.

    n is the number of occurrences, before and after those with a word of the same piece on that side.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word's phrases take up about six times its bytes; a part of them meets in one task.
    parts = int(min(MOST_PARTS - 1, max(1, 6 * size // PART_BYTES)))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.column("text").nbytes
            if held >= SHARD_BYTES:
                yield from indexed(waiting)
                waiting, held = [], 0
        yield from indexed(waiting)

    def indexed(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not waiting:
            return
        table = pa.Table.from_batches(waiting)
        for lang in table["lang"].unique():
            shard = Shard(table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks())
            if not shard.n_words:
                continue
            rows = [*_parts(shard, parts, depth), (0, b"\n", np.array([[shard.n_words] * 3], np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())]
            for i in range(0, len(rows), 64):
                part, phrases, numbers = zip(*rows[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([lang.as_py()] * len(part), pa.string()), pa.array(phrases, pa.binary()), pa.array(numbers, pa.binary())], names=["part", "lang", "phrases", "numbers"])

    def summed(table: pa.Table) -> pa.Table:
        names = table["lang"].unique().to_pylist()
        pieces = []
        for lang, phrases, numbers in zip(table["lang"].to_pylist(), table["phrases"], table["numbers"], strict=True):
            lines = _lines(phrases.as_py())
            n = np.ascontiguousarray(np.frombuffer(numbers.as_py(), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(3, -1).astype(np.int64)
            pieces.append(pa.table([pa.array(np.full(len(lines), names.index(lang), np.int32)), lines, *map(pa.array, n)], names=["lang", "phrase", "n", "before", "after"]))
        total = pa.concat_tables(pieces).group_by(["lang", "phrase"], use_threads=False).aggregate([(c, "sum") for c in ("n", "before", "after")])
        total = total.filter(pc.or_(pc.greater_equal(total["n_sum"], least), pc.equal(total["phrase"], b"\n")))
        phrase = pc.utf8_slice_codeunits(pc.cast(pc.cast(total["phrase"], pa.large_string()), pa.string()), 0, -1)
        lang = pa.array([names[i] for i in total["lang"].to_pylist()], pa.string())
        words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1))
        return pa.table([lang, phrase, pc.cast(words, pa.int32()), total["n_sum"], total["before_sum"], total["after_sum"]], names=["lang", "phrase", "words", "n", "before", "after"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(shards, COUNTED).groupBy("part").applyInArrow(summed, SUMS)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: it is at most 1000000, as a phrase occurs no more often than its parts."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(1_000_000), 7) * wide(a, 12) * wide(a, 12), wide(left, 12) * wide(right, 12))


def scored(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more of counts(), by its lowest-scoring cut (the first of equal ones)."""
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.slice(word, F.lit(1), k)).alias("left"), F.concat_ws(" ", F.slice(word, k + 1, F.col("words") - k)).alias("right")))
    sides = candidates.select("lang", "phrase", "words", "a", F.explode(cuts).alias("cut")).select(
        "lang", "phrase", "words", "a", "cut.k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("cut.left").alias("part")), F.struct(F.lit(1).alias("side"), F.col("cut.right").alias("part")))).alias("x")
    )
    parts = found.where(F.col("words").between(1, depth - 1)).select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part_phrase"), F.col("n").alias("f"))
    known = sides.select("*", "x.side", "x.part").join(parts, (F.col("lang") == F.col("part_lang")) & (F.col("part") == F.col("part_phrase")))
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    wide = known.groupBy("lang", "phrase", "words", "a").agg(*[at(k, s).alias(f"f{k}{s}") for k in range(1, depth) for s in (0, 1)])
    cut = lambda k: F.when(F.col(f"f{k}0").isNotNull(), F.struct(_score(F.col("a"), F.col(f"f{k}0"), F.col(f"f{k}1")).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")))
    best = F.least(*[cut(k) for k in range(1, depth)]) if depth > 2 else cut(1)
    return wide.select("lang", "phrase", "words", "a", best.alias("best")).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncovered(rows: DataFrame, depth: int = DEPTH, covered: int = COVERED) -> DataFrame:
    """rows (lang, phrase, words, a) without those whose words lie within a longer phrase that has covered percent of their occurrences."""
    word = F.split("phrase", " ")
    spans = [F.when(F.col("words") >= max(k + 1, k + i - 1), F.concat_ws(" ", F.slice(word, i, k))) for k in range(2, depth) for i in range(1, depth - k + 2)]
    inner = rows.select(F.col("lang").alias("in_lang"), "phrase", "a", F.explode(F.array_distinct(F.array(*spans))).alias("in_phrase")).where("in_phrase is not null")
    most = inner.groupBy("in_lang", "in_phrase").agg(F.max("a").alias("longer"))
    joined = rows.join(most, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    return joined.where(F.expr(f"longer is null or 100 * longer < {covered} * a")).drop("in_lang", "in_phrase", "longer")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, most: int = MOST, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, before, after: each language's first phrases by score."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(counts(docs, depth, least), "phrases")
    rows = uncovered(scored(found, depth), depth, covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    words = found.where("words = 0").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    sides = found.select(F.col("lang").alias("side_lang"), F.col("phrase").alias("side_phrase"), "before", "after")
    told = first.join(words, F.col("lang") == F.col("of")).join(sides, (F.col("lang") == F.col("side_lang")) & (F.col("phrase") == F.col("side_phrase")))
    return told.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "before", "after")
