"""Best-fit packing by exact-complement hashing.

Documents are tokenised, closed by an end token, and cut only where longer than a sequence: the first
piece takes the remainder, the others are whole sequences. How many pieces there are of each length is a
histogram of at most ``size`` entries, whatever the data's size; the plan is made from it alone:

1. sums of one and two lengths are indexed (three are one and two), short ones (under a 16th or a 32nd of a sequence) kept back; for each length, longest first, what
   exactly fills the rest of its sequence is looked up and taken as often as all the lengths in it are available;
2. the long lengths that remain go, longest first, to the open sequence with the least room that fits;
3. sums of one, two and three short lengths are looked up for what exactly fills the gaps that are left, and taken in the same way;
4. what remains goes to the open sequences by best fit.

With few pieces a length, exact fillings early on can leave the rest without partners, so plans that seek pairs and triples only for long lengths are made too, and the one
with fewest sequences is taken. Short lengths fill any gap, so they are kept until the gaps are known. The plan says which pieces of a length, by rank, go to which
sequences. Whole sequences need no rank. Other pieces get theirs from counts by (length, salt), with a salt for each ``RUN`` pieces
of a length, so no length meets in one task.

Defined cases: a null text is empty, so its document is the end token alone; an empty table gives no rows; repeated
rows are documents of their own, told apart by nothing but their place; null ids are kept.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import Scratch

SIZE, END_ID, RUN = 1024, 2, 1 << 20
TOKENIZER = "byte_bpe_50k.json"

#: Texts of other characters, and texts with one of the tokenizer's special tokens, are encoded by the tokenizers library. For the rest
#: tiktoken, given the same vocabulary as ranks, makes the same ids several times faster (a test compares the two).
OTHER_CHARS = r"[^\t-\r -~\x{a1}-\x{24f}]"

_encoders: dict[str, tuple] = {}


def _encoder(path: str) -> tuple:
    """The tokenizer of the JSON file, and tiktoken's with the ranks beside it; loaded once a worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = whole, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_ids(encoder: tuple, texts: pa.Array) -> list[np.ndarray]:
    """The ids of each text."""
    whole, fast = encoder
    texts = texts.fill_null("")
    other = pc.match_substring_regex(texts, OTHER_CHARS)
    for special in {t.content for t in whole.get_added_tokens_decoder().values()}:
        other = pc.or_(other, pc.match_substring(texts, special))
    other = other.to_pylist()
    strings = texts.to_pylist()
    slow = iter(whole.encode_batch_fast([s for s, o in zip(strings, other, strict=True) if o], add_special_tokens=False))
    return [np.array(next(slow).ids if o else fast.encode_ordinary(s), np.uint32) for s, o in zip(strings, other, strict=True)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                rows: list[tuple] = []
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), token_ids(encoder, b.column("text")), strict=True):
                    n = len(ids)
                    own = np.append(ids, np.uint32(end_id)).astype("<u4")
                    end = (n + 1) % size or size
                    start, k = 0, 0
                    while start <= n:
                        rows.append((doc_id, k, start, end - start, zlib.crc32(own[start:end].tobytes())))
                        start, end, k = end, end + size, k + 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


Pattern = tuple[tuple[int, ...], int]


def plan(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """(lengths in a sequence, number of such sequences), using every piece once.

    Of a few plans, which differ in how long a sequence's longest piece must be for pairs and triples to be sought and in which short lengths are
    kept back, the one with fewest sequences is taken, and of equal ones the one that seeks exact fillings most. A plan at the least possible number ends the search.
    """
    least = -(-sum(k * n for k, n in histogram.items()) // size)
    best: list[Pattern] = []
    for longest in (1, size * 5 // 8, size * 11 // 16, size):
        for part in (16, 32):
            made = _plan(histogram, size, max(size // part, 1), longest)
            if not best or sum(n for _, n in made) < sum(n for _, n in best):
                best = made
            if sum(n for _, n in best) == least:
                return best
    return best


def _take(left: Counter | np.ndarray, lengths: tuple[int, ...], most: int) -> int:
    """How often, up to ``most``, the lengths are available together; they are then taken."""
    need = Counter(lengths)
    times = int(min(most, *(left[k] // v for k, v in need.items())))
    for k, v in need.items():
        left[k] -= v * times
    return times


class Sums:
    """Index of the sums of one and two available lengths; three are one and two. Lengths that are used up stay in it and are passed over."""

    def __init__(self, left: np.ndarray, least: int):
        self.left, self.least = left, least
        own = np.flatnonzero(left)[::-1]
        own = own[own >= least]
        self.lengths = own
        #: For each sum, the longer lengths of its pairs, long ones first.
        self.pairs: dict[int, np.ndarray] = {}
        for total in range(2 * least, len(left)):
            b = own[(own * 2 >= total) & (own <= total - least)]
            b = b[left[total - b] > 0]
            if len(b):
                self.pairs[total] = b

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The pair with the longest length up to ``most`` that makes the total."""
        b = self.pairs.get(total)
        if b is None:
            return None
        hit = np.flatnonzero((self.left[b] > (2 * b == total)) & (self.left[total - b] > 0) & (b <= most))
        return (int(b[hit[0]]), total - int(b[hit[0]])) if len(hit) else None

    def filling(self, gap: int, deep: bool) -> tuple[int, ...] | None:
        """One length that makes the gap, else (deep) two, else three."""
        if gap >= self.least and self.left[gap] > 0:
            return (gap,)
        if not deep:
            return None
        if two := self.pair(gap, gap):
            return two
        for b in self.lengths[(self.lengths <= gap - 2 * self.least) & (self.left[self.lengths] > 0)].tolist():
            self.left[b] -= 1
            two = self.pair(gap - b, b)
            self.left[b] += 1
            if two:
                return (b, *two)
        return None

    def beside(self, a: int, total: int, deep: bool) -> tuple[int, ...] | None:
        """What fills a sequence up to the total beside a length that is itself available."""
        self.left[a] -= 1
        fill = self.filling(total - a, deep)
        self.left[a] += 1
        return fill


def _plan(histogram: dict[int, int], size: int, short: int, longest: int) -> list[Pattern]:
    left = np.zeros(size + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    full: list[Pattern] = []
    if left[size]:
        full.append(((size,), int(left[size])))
        left[size] = 0
    sums = Sums(left, short)
    for a in sums.lengths.tolist():
        while left[a] > 0 and (fill := sums.beside(a, size, a >= longest)):
            full.append(((a, *fill), _take(left, (a, *fill), int(left[a]))))
        if a < longest and 2 * a < size:
            break
    available = {k: int(left[k]) for k in np.flatnonzero(left).tolist()}
    opened = _best_fit({k: n for k, n in available.items() if k >= short}, size, [])
    small = Counter({k: n for k, n in available.items() if k < short})
    #: For each sum, the one, two or three short lengths that make it, long ones first.
    short_sums: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for many in (1, 2, 3):
        for lengths in combinations_with_replacement(sorted(small, reverse=True), many):
            short_sums[sum(lengths)].append(lengths)
    gaps: list[tuple[int, tuple[int, ...], int]] = []
    for room, lengths, n in sorted(opened, reverse=True):
        for fill in short_sums.get(room, ()):
            times = _take(small, fill, n)
            full.append(((*lengths, *fill), times))
            n -= times
        gaps.append((room, lengths, n))
    return [p for p in full if p[1]] + [(lengths, n) for _, lengths, n in _best_fit(small, size, gaps)]


def _best_fit(left: dict[int, int], size: int, opened: list[tuple[int, tuple[int, ...], int]]) -> list[tuple[int, tuple[int, ...], int]]:
    """Best fit, longest first, over groups of equal open sequences (room, lengths, how many); as many at once as the group and the length allow."""
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, lengths: tuple[int, ...], n: int) -> None:
        if not open_by_room[room]:
            bisect.insort(rooms, room)
        open_by_room[room].append([lengths, n])

    for room, lengths, n in opened:
        if n:
            add(room, lengths, n)
    for k in sorted((k for k in left if left[k] > 0), reverse=True):
        n = left[k]
        while n:
            i = bisect.bisect_left(rooms, k)
            if i == len(rooms):
                fit = size // k
                if n >= fit:
                    add(size - fit * k, (k,) * fit, n // fit)
                    n %= fit
                else:
                    add(size - n * k, (k,) * n, 1)
                    n = 0
                continue
            room = rooms[i]
            lengths, many = open_by_room[room][-1]
            used = min(many, n)
            if used == many:
                open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(i)
            else:
                open_by_room[room][-1][1] -= used
            add(room - k, (*lengths, k), used)
            n -= used
    return [(room, lengths, n) for room, groups in open_by_room.items() for lengths, n in groups if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of pieces."""
    next_rank: Counter = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for lengths, n in patterns:
        offset = 0
        for k in lengths:
            runs[k].append((next_rank[k], first, offset))
            next_rank[k] += n
            offset += k
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def ranked(cut: DataFrame, size: int = SIZE) -> tuple[DataFrame, dict[int, int]]:
    """The pieces shorter than ``size`` with their rank (from 0) among those of their length, and the histogram of these."""
    part = cut.where(F.col("length") < size)
    histogram = dict(map(tuple, part.groupBy("length").count().collect()))  # at most size rows
    salts = cut.sparkSession.createDataFrame([(k, -(-n // RUN)) for k, n in sorted(histogram.items())], "length long, salts long")
    salted = part.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    before: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    # A row for each length and, beyond, for each RUN pieces.
    for length, salt, n in sorted(map(tuple, salted.groupBy("length", "salt").count().collect())):
        before[length, salt] = seen[length]
        seen[length] += n
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    local = salted.withColumn("local", F.row_number().over(w) - 1).select(*_PIECE_NAMES, "salt", "local")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [before[x] for x in zip(b.column("length").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            rank = pa.array(np.array(base, np.int64) + np.asarray(b.column("local")).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _PIECE_NAMES], rank], names=[*_PIECE_NAMES, "rank"])

    return local.mapInArrow(run, PIECES + ", rank long"), histogram


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of documents (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, tokenizer_path, size, end_id), "pieces")
    with_rank, histogram = ranked(cut, size)
    patterns = plan(histogram, size)
    place, planned = slots(patterns), sum(n for _, n in patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                ranks, firsts, offsets = place[k]
                i = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own], offset[own] = firsts[i] + rank[own] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _PIECE_NAMES], pa.array(sequence), pa.array(offset)], names=[*_PIECE_NAMES, "sequence_id", "offset"])

    # A piece of a whole sequence is one; its number is from its place in the table just written.
    whole = cut.where(F.col("length") == size).select(*_PIECE_NAMES, (F.monotonically_increasing_id() + planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return with_rank.mapInArrow(run, PIECES + ", sequence_id long, offset long").unionByName(whole)
