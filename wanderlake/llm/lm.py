"""Language-model scores from an Elias-Fano n-gram trie.

Level one holds the words: an Elias-Fano sequence of their hashes (a word's id is its place) and exact counts. Level two holds,
for all words and the start of a text on end, their successors; level three, for all entries of level two on end, theirs.
In level three a word is replaced by its place among the successors of the word before it, which level two has. A
level is two Elias-Fano sequences, pointers to each context's successors and the successors made monotone by the last one
of the context before, with the smoothed probability of each entry and the weight with which each context falls back on the order below.
An entry is found by successor search within its context's range.

Probabilities are of an interpolated model with absolute discounting at each order over a unigram with 0.1 added to each count.
Counts are taken over every training text; nothing is pruned. A level is smoothed once all its counts are there: a context's total
is its own count one level down, the number of its successors the distance of two pointers, the lower order the level below as stored.
The running counts, Elias-Fano sequences too, go once the trie is built. Probabilities and weights are kept as base-10 logarithms on an even grid of
``2 ** bits`` steps over ``DECADES``, packed to ``bits`` bits, so each is off by at most ``DECADES / 2 ** (bits + 1)``: 1/512 at 12 bits, and a
token's score by at most two such errors (its own and that of the order below, or two weights). With ``bits=0`` they are doubles.

Level one is cut by ranges of hashes. The others are cut by ranges of (context, successor), of about ``LOAD`` training tokens each, so
that the successors of a frequent context lie in several shards and no task holds more than its range. Each shard is one file
in the shared folder, written whole and then renamed, so a lost task can be run again; workers map the files and read what they touch.

Defined cases: a null text is empty and has the end token alone; a null id counts as the empty string; repeated rows count
as often as they stand; words never seen in training have the smoothed share of one unseen word; with no training text
every token has that share; an empty table gives no rows.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import eliasfano as ef
from . import text as tx
from .scratch import Scratch

U64 = np.uint64
ADD, DISCOUNT, SHARD_BYTES, MOST_SHARDS = 0.1, 0.75, 16 << 20, 1 << 16
#: Training tokens whose counts meet in one shard of levels two and three.
LOAD = 2 << 20
#: Decades that the grid of quantised logarithms covers. The least value is a quarter of one count in all tokens, so it does for 10^15 tokens.
DECADES = 16
END = tx.mix(np.array([0x454E44], U64))[0]


class Store:
    """Files under a URI that driver and executors share; mapped where the file system is local, else fetched once a worker."""

    _mapped: dict[str, dict[str, np.ndarray]] = {}

    def __init__(self, uri: str):
        self.uri = uri

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        f, root = self._fs()
        f.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        part = f"{root}/{name}.{uuid.uuid4().hex}"
        with f.open_output_stream(part) as out:
            out.write(ef.pack(arrays))
        f.move(part, f"{root}/{name}")

    def drop(self, folder: str) -> None:
        f, root = self._fs()
        f.create_dir(f"{root}/{folder}", recursive=True)
        f.delete_dir(f"{root}/{folder}")

    def read(self, name: str) -> dict[str, np.ndarray]:
        key = f"{self.uri}/{name}"
        if key not in self._mapped:
            # A worker may serve several tries in turn; only the shards of the one in use stay mapped.
            for old in [k for k in self._mapped if not k.startswith(f"{self.uri}/")]:
                del self._mapped[old]
            f, root = self._fs()
            path = f"{root}/{name}"
            if f.type_name != "local":
                # A copy without a name: it is gone when the worker ends, or when its mapping is dropped.
                with f.open_input_stream(f"{root}/{name}") as src, tempfile.TemporaryFile() as copy:
                    shutil.copyfileobj(src, copy)
                    copy.flush()
                    self._mapped[key] = ef.unpack(np.memmap(copy, np.uint8, "r"))
                return self._mapped[key]
            self._mapped[key] = ef.unpack(np.memmap(path, np.uint8, "r"))
        return self._mapped[key]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end token, and the n+1 offsets."""
    word, at = tx.words(texts)
    out = np.insert(word, at[1:], END) if len(at) > 1 else np.zeros(0, U64)
    return out, at + np.arange(len(at))


def _of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [tokens(b.column("text")) for b in tx.chunks(batch, "text")]
    if not parts:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each one's place among them; words repeat much, so a hash table is quicker than a sort of all."""
    found = pa.array(values.view(np.int64)).dictionary_encode()
    different = np.asarray(found.dictionary).view(U64)
    order = np.argsort(different)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return different[order], place[np.asarray(found.indices)]


def _squeezed(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte planes on end: the high ones are nearly all zero, which the shuffle's compression takes out."""
    d = np.diff(sorted_keys, prepend=U64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unsqueezed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U64), dtype=U64)


def _by_shard(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: its keys (sorted) and counts."""
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(shard))[: len(cuts)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard[cuts], pa.int32()),
            pa.array([_squeezed(keys[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([_squeezed(np.cumsum(counts[a:b]).astype(U64)) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        ],
        names=["shard", "keys", "counts"],
    )


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([_unsqueezed(r.as_py()) for r in table["keys"]])
    counts = np.concatenate([np.diff(_unsqueezed(r.as_py()), prepend=U64(0)) for r in table["counts"]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


COUNTED = "shard int, keys binary, counts binary"


def _cuts(counts: np.ndarray, load: int) -> tuple[list[int], list[float]]:
    """Where ranges of about load begin: an item, and which share of it lies before. Only items of more than load are cut inside."""
    ends = np.cumsum(counts)
    target = np.arange(load, int(ends[-1]) if len(ends) else 0, load)
    item = np.searchsorted(ends, target, "right")
    share = np.where(counts[item] > load, (target - ends[item] + counts[item]) / counts[item], 0.0)
    return [0, *item.tolist()], [0.0, *share.tolist()]


class Words:
    """Level one's ids and counts, read from the mapped shards. Hashes and ids must come sorted."""

    def __init__(self, store: Store, shard_bits: int, base: np.ndarray):
        self.store, self.bits, self.base = store, shard_bits, base

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if unknown) and count of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted((hashes >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64), np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero((np.diff(cut) > 0) & (np.diff(self.base) > 0)).tolist():
            a, b = cut[s], cut[s + 1]
            arrays = self.store.read(f"words-{s}")
            at = ef.Sequence(arrays, "hash").find(hashes[a:b] & U64((1 << (64 - self.bits)) - 1))
            known = at >= 0
            ids[a:b] = np.where(known, at + self.base[s], -1)
            counts[a:b] = np.where(known, arrays["count"][np.maximum(at, 0)].astype(np.int64), 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.base)
        for s in np.flatnonzero(np.diff(cut) > 0).tolist():
            out[cut[s] : cut[s + 1]] = self.store.read(f"words-{s}")["count"][ids[cut[s] : cut[s + 1]] - self.base[s]]
        return out


class Level:
    """The successors of all contexts. Its keys are context * size + successor; shard s begins with the key cuts[s]."""

    def __init__(self, store: Store, name: str, cuts: np.ndarray, size: int, contexts: int, bits: int):
        self.store, self.name, self.size, self.contexts, self.bits = store, name, size, contexts, bits
        self.cuts = np.unique(np.append(cuts.astype(U64), U64(0)))
        self.first = (self.cuts // U64(size)).astype(np.int64)
        self.base = np.zeros(len(self.cuts) + 1, np.int64)

    def shards(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, keys, "right") - 1

    def keys(self, context: np.ndarray, successor: np.ndarray | int) -> np.ndarray:
        return context.astype(U64) * U64(self.size) + np.asarray(successor).astype(U64)

    def write(self, shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        context, x = (keys // U64(self.size)).astype(np.int64), (keys % U64(self.size)).astype(np.int64)
        last = self.first[shard + 1] if shard + 1 < len(self.first) else self.contexts - 1
        pointers = np.searchsorted(context, np.arange(self.first[shard], last + 2))
        ends = np.flatnonzero(np.append(context[1:] != context[:-1], True))
        before = np.concatenate([[0], np.cumsum(x[ends])[:-1]])
        values = x + np.repeat(before, np.diff(ends, prepend=-1))
        sums = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        self.store.write(f"{self.name}-{shard}", {**ef.encode(pointers, len(keys) + 1, "pointer"), **ef.encode(values, int(values[-1]) + 1, "successor")})
        self.store.write(f"counts/{self.name}-{shard}", ef.encode(sums, int(sums[-1]) + 1, "sum"))

    def range(self, shard: int) -> np.ndarray:
        """The contexts that have keys in a shard; those at its ends may have others elsewhere."""
        return np.arange(self.first[shard], (self.first[shard + 1] if shard + 1 < len(self.first) else self.contexts - 1) + 1)

    def entries(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Place in range(shard) of each entry's context, and the entry's successor."""
        if self.base[shard + 1] == self.base[shard]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        arrays = self.store.read(f"{self.name}-{shard}")
        pointer, values = (s.get(np.arange(s.n)).astype(np.int64) for s in (ef.Sequence(arrays, "pointer"), ef.Sequence(arrays, "successor")))
        before = np.where(pointer[:-1] > 0, values[np.maximum(pointer[:-1] - 1, 0)], 0)
        owner = np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
        return owner, values - before[owner]

    def write_model(self, shard: int, prob: np.ndarray, fall: np.ndarray) -> None:
        """log10 of the probability of each entry and of the weight of each context of the shard."""
        kept = lambda x: ef.pack_bits(np.clip(np.rint(-x * ((1 << self.bits) / DECADES)), 0, (1 << self.bits) - 1), self.bits) if self.bits else x
        self.store.write(f"{self.name}-model-{shard}", {"prob": kept(prob), "fall": kept(fall)})

    def _logs(self, shard: int, name: str, i: np.ndarray) -> np.ndarray:
        kept = self.store.read(f"{self.name}-model-{shard}")[name]
        return ef.take_bits(kept, i, self.bits) * (-DECADES / (1 << self.bits)) if self.bits else kept[i]

    def _by_place(self, place: np.ndarray) -> Iterator[tuple[slice, int]]:
        cut = np.searchsorted(place, self.base)
        for s in np.flatnonzero(np.diff(cut) > 0).tolist():
            yield slice(cut[s], cut[s + 1]), s

    def counts(self, place: np.ndarray) -> np.ndarray:
        """Count of the entry at each place (sorted). Only while the trie is built."""
        out = np.zeros(len(place), np.int64)
        for rows, s in self._by_place(place):
            sums, at = ef.Sequence(self.store.read(f"counts/{self.name}-{s}"), "sum"), place[rows] - self.base[s]
            out[rows] = (sums.get(at + 1) - sums.get(at)).astype(np.int64)
        return out

    def log_prob(self, place: np.ndarray) -> np.ndarray:
        """log10 of the smoothed probability of the entry at each place (sorted)."""
        out = np.zeros(len(place))
        for rows, s in self._by_place(place):
            out[rows] = self._logs(s, "prob", place[rows] - self.base[s])
        return out

    def fall_back(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """log10 of what the order below weighs in each context; sorted by context and successor."""
        out = np.zeros(len(context))
        cut = np.searchsorted(self.shards(self.keys(context, successor)), np.arange(len(self.cuts) + 1))
        for s in np.flatnonzero(np.diff(cut) > 0).tolist():
            out[cut[s] : cut[s + 1]] = self._logs(s, "fall", context[cut[s] : cut[s + 1]] - self.first[s])
        return out

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[slice, int, dict[str, np.ndarray]]]:
        """Rows (sorted by shard), the shard and its arrays, for shards that hold anything."""
        cut = np.searchsorted(shard, np.arange(len(self.cuts) + 1))
        for s in np.flatnonzero((np.diff(cut) > 0) & (np.diff(self.base) > 0)).tolist():
            yield slice(cut[s], cut[s + 1]), s, self.store.read(f"{self.name}-{s}")

    def starts(self, context: np.ndarray) -> np.ndarray:
        """Place of the first successor of each context (sorted); of all entries for the context after the last."""
        shard = self.shards(self.keys(context, 0))
        out = self.base[shard].copy()
        for rows, s, arrays in self._by_shard(shard):
            out[rows] += ef.Sequence(arrays, "pointer").get(np.minimum(context[rows], self.contexts) - self.first[s]).astype(np.int64)
        return out

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of each entry (-1 if there is none); sorted by context and successor."""
        place = np.full(len(context), -1, np.int64)
        for rows, s, arrays in self._by_shard(self.shards(self.keys(context, successor))):
            distinct, back = np.unique(context[rows] - self.first[s], return_inverse=True)
            pointer, values = ef.Sequence(arrays, "pointer"), ef.Sequence(arrays, "successor")
            lo, hi = (pointer.get(distinct + j).astype(np.int64) for j in (0, 1))
            before = np.where(lo > 0, values.get(np.maximum(lo - 1, 0)).astype(np.int64), 0)
            want = successor[rows] + before[back]
            top = int(values.get(np.array([values.n - 1]))[0])
            at = np.where(want <= top, values.find(np.minimum(want, top), lo[back], hi[back]), -1)
            place[rows] = np.where(at >= 0, at + self.base[s], -1)
        return place


class Trie:
    """What tasks need to use the trie: where its files are, and its sizes."""

    def __init__(self, store: Store, shard_bits: int, base: np.ndarray, n_tokens: int):
        self.store, self.words, self.n_tokens = store, Words(store, shard_bits, base), n_tokens
        self.v = int(base[-1])
        self.mass = n_tokens + ADD * (self.v + 1)
        self.n_texts = int(self.words.ids(np.array([END], U64))[1][0])
        self.two: Level | None = None
        self.three: Level | None = None

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / self.mass

    def pairs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The id before each token; v before a text's first."""
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[at[:-1]] = self.v
        return before

    def second(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in level two of each pair (sorted; -1 is unknown), and its place among its context's successors (-1 likewise)."""
        place, nth = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        both = np.flatnonzero((context >= 0) & (word >= 0))
        place[both] = self.two.find(context[both], word[both])
        hit = np.flatnonzero(place >= 0)
        distinct, back = np.unique(context[hit], return_inverse=True)
        nth[hit] = place[hit] - self.two.starts(distinct)[back]
        return place, nth

    @staticmethod
    def _logs(level: Level, place: np.ndarray, context: np.ndarray, successor: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """A level's log10 probabilities: as stored where there is a place, else the lower order's, weighed where the context is known. Sorted."""
        out = lower.copy()
        hit = np.flatnonzero(place >= 0)
        out[hit] = level.log_prob(place[hit])
        miss = np.flatnonzero((place < 0) & (context >= 0))
        out[miss] += level.fall_back(context[miss], np.maximum(successor[miss], 0))
        return out

    def log_prob(self, word: np.ndarray, at: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token (ids, -1 if unknown) after those before it. lower: the unigram's probability."""
        # Each different pair once, in order of contexts: unknown words as one, as any of them has the same unigram.
        pair, first, back = np.unique((self.pairs(word, at) + 1) * (self.v + 2) + (word + 1), return_index=True, return_inverse=True)
        context, last = pair // (self.v + 2) - 1, pair % (self.v + 2) - 1
        place, nth = self.second(context, last)
        p = self._logs(self.two, place, context, last, np.log10(lower[first]))
        out = p[back]
        if self.three is None:
            return out
        later = np.setdiff1d(np.arange(len(word)), at[:-1], assume_unique=True)
        n = max(len(pair), 1)
        three, again = np.unique(back[later - 1] * n + back[later], return_inverse=True)
        context, last = place[three // n], three % n
        found, both = np.full(len(three), -1, np.int64), np.flatnonzero((context >= 0) & (nth[last] >= 0))
        found[both] = self.three.find(context[both], nth[last[both]])
        out[later] = self._logs(self.three, found, context, nth[last], p[last])[again]
        return out

    def smooth(self, level: Level, shard: int) -> None:
        """Probabilities and weights of a shard of level two or three, from the counts and the level below. Written whole, so it can be done again."""
        context = level.range(shard)
        kinds = level.starts(context + 1) - level.starts(context)
        owner, successor = level.entries(shard)
        if level is self.two:
            total = np.append(self.words.counts(context[context < self.v]), np.full(int((context == self.v).sum()), self.n_texts))
            word, back = np.unique(successor, return_inverse=True)
            lower = np.log10(self.unigram(self.words.counts(word)))[back]
        else:
            total = self.two.counts(context)
            # A context is a pair; its last word's successors are where the order below has its probabilities.
            held = range(*(int(np.searchsorted(self.two.base, x, "right")) - 1 + i for i, x in enumerate((context[0], context[-1])))) if len(context) else range(0)
            word = np.concatenate([np.zeros(0, np.int64), *(self.two.entries(s)[1] for s in held)])
            word = word[context - self.two.base[held.start]] if len(context) else word
            distinct, back = np.unique(word, return_inverse=True)
            below, again = np.unique(self.two.starts(distinct)[back][owner] + successor, return_inverse=True)
            lower = self.two.log_prob(below)[again]
        weight = DISCOUNT * kinds / np.maximum(total, 1)
        count = level.counts(np.arange(level.base[shard], level.base[shard + 1]))
        prob = np.log10((count - DISCOUNT) / total[owner] + weight[owner] * 10**lower)
        # What never stands before another token (the end of a text) has no successors, and is never asked for.
        level.write_model(shard, prob, np.log10(np.where(kinds > 0, weight, 1.0)))


def fit(docs: DataFrame, order: int = 2, bits: int = 0) -> Trie:
    """Counts the training texts of docs (doc_id, text) and builds the trie of order 2 or 3, its probabilities in bits bits (1 to 32; 0: doubles)."""
    if order not in (2, 3) or not 0 <= bits <= 32:
        raise ValueError("order is 2 or 3, bits 0 to 32")
    spark = docs.sparkSession
    texts = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    high = min(MOST_SHARDS, max(8, size // SHARD_BYTES)).bit_length() - 1
    # Removed with the session's other intermediate tables: scores are read from the files until then.
    store = Store(f"{Scratch(spark).root}/trie")
    load = LOAD
    made = "shard int, n long, total long, item array<long>, share array<double>, word array<long>"

    def report(shard: int, keys: np.ndarray, counts: np.ndarray, word: np.ndarray) -> pa.Table:
        item, share = _cuts(counts.astype(np.int64), load)
        wide = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
            "item": wide(item, pa.int64()), "share": wide(share, pa.float64()), "word": wide(word[item].tolist(), pa.int64()),
        })

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(_of_batch(batch)[0], return_counts=True)
            yield _by_shard(keys, counts, (keys >> U64(64 - high)).astype(np.int64))

    def level_one(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _merged(table)
        store.write(f"words-{shard}", {**ef.encode(keys & U64((1 << (64 - high)) - 1), 1 << (64 - high), "hash"), "count": counts.astype(np.int64)})
        return report(shard, keys, counts, np.zeros(len(keys), np.int64))

    def smooth(level: Level) -> None:
        name = level.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("id").to_pylist():
                    trie.smooth(trie.two if name == "pairs" else trie.three, shard)
                yield batch

        # Also the shards without entries: their contexts have weights.
        n = len(level.cuts)
        spark.range(0, n, 1, min(n, MOST_SHARDS)).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()

    # A row a shard, and all of them together one number for each LOAD of tokens.
    found = texts.mapInArrow(words, COUNTED).groupBy("shard").applyInArrow(level_one, made).collect()
    base = np.zeros((1 << high) + 1, np.int64)
    for r in found:
        base[r["shard"] + 1] = r["n"]
    trie = Trie(store, high, np.cumsum(base), sum(r["total"] for r in found))
    contexts = trie.v + 1
    inside = _cuts(np.array([trie.n_texts]), load)
    cuts = [(int(trie.words.base[r["shard"]]) + i) * contexts + int(f * contexts) for r in found for i, f in zip(r["item"], r["share"], strict=True)]
    cuts += [trie.v * contexts + int(f * contexts) for f in inside[1]]
    two = Level(store, "pairs", np.array(cuts, U64), contexts, contexts, bits)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, at = _of_batch(batch)
            distinct, back = _distinct(token)
            ids = trie.words.ids(distinct)[0][back]
            keys, counts = np.unique(two.keys(trie.pairs(ids, at), ids), return_counts=True)
            yield _by_shard(keys, counts, two.shards(keys))

    def level_two(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _merged(table)
        two.write(shard, keys, counts)
        return report(shard, keys, counts, (keys % U64(two.size)).astype(np.int64))

    found = texts.mapInArrow(pairs, COUNTED).groupBy("shard").applyInArrow(level_two, made).collect()
    for r in found:
        two.base[r["shard"] + 1] = r["n"]
    two.base = np.cumsum(two.base)
    trie.two = two
    smooth(two)
    if order < 3:
        store.drop("counts")
        return trie

    cuts = []
    for r in found:
        for i, f, w in zip(r["item"], r["share"], r["word"], strict=True):
            # Only a pair of more than LOAD tokens is cut inside, by its last word's successors.
            kinds = int(np.diff(two.starts(np.array([w, w + 1])))[0]) if f else 0
            cuts.append((int(two.base[r["shard"]]) + i) * contexts + int(f * kinds))
    three = Level(store, "triples", np.array(cuts, U64), contexts, int(two.base[-1]), bits)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, at = _of_batch(batch)
            distinct, back = _distinct(token)
            ids = trie.words.ids(distinct)[0][back]
            pair, back = np.unique(two.keys(trie.pairs(ids, at), ids), return_inverse=True)
            place, nth = trie.second((pair // U64(two.size)).astype(np.int64), (pair % U64(two.size)).astype(np.int64))
            later = np.setdiff1d(np.arange(len(ids)), at[:-1], assume_unique=True)
            keys, counts = np.unique(three.keys(place[back[later - 1]], nth[back[later]]), return_counts=True)
            yield _by_shard(keys, counts, three.shards(keys))

    def level_three(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _merged(table)
        three.write(shard, keys, counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    for r in texts.mapInArrow(triples, COUNTED).groupBy("shard").applyInArrow(level_three, "shard int, n long").collect():
        three.base[r["shard"] + 1] = r["n"]
    three.base = np.cumsum(three.base)
    trie.three = three
    smooth(three)
    store.drop("counts")
    return trie


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """n_tokens, n_known, base_score and score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token, at = _of_batch(batch)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            distinct, back = _distinct(token)
            ids, counts = trie.words.ids(distinct)
            lower = trie.unigram(counts)[back]
            lp = trie.log_prob(ids[back], at, lower)
            total = lambda x: np.bincount(owner, weights=x, minlength=len(at) - 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at)), pa.array(total(counts[back] > 0).astype(np.int64)),
                    pa.array(np.full(n, trie.n_tokens)), pa.array(total(np.log10(lower))), pa.array(total(lp)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCORED)
