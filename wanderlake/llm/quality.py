"""Quality by co-training of two views.

The content view is linear in the text's features, the metadata view in a page's source, language and length; either also has an
evidence column. Each round, all unlabelled documents are scored by both views, map-side, and each view labels those it is
sure of for the other one. What a view learns from its pseudo-labels is how often each bucket occurs in either class, counted by
tasks and summed in Spark; the sum of log ratios over a document's buckets is the view's evidence, with which it is fitted
again. At last each view's margins are calibrated on labelled documents that neither learned from, both are combined, and
all documents are scored.

Only labelled rows are sampled (at most ``sample`` a class, chosen by a hash of the id): their fit is one task. All unlabelled rows
take part in every round. The counts are at most ``EVIDENCE`` numbers a class, whatever the data's size.

Defined cases: a null text is empty, a null source or language is a value of its own, a null length is
taken from the text; rows with a null id are unlabelled; labels with a null are left out; of labels repeated for one id the greatest
quality counts; without labels every document is kept with the score 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as ft
from . import text as tx
from .scratch import Scratch
from .toxicity import marked_labels

SAMPLE, ROUNDS, SURE = 4000, 2, 0.97
#: Buckets of evidence (a sixteenth of all buckets), and labelled ids that may be broadcast.
EVIDENCE_BITS = 18
EVIDENCE, IDS_BROADCAST = 1 << EVIDENCE_BITS, 1_000_000
META = ("source", "lang", "n_chars")


def meta_features(batch: pa.RecordBatch) -> ft.Sparse:
    """Source and language as buckets; the length, its square and whether it was given as dense columns."""
    n = batch.num_rows
    named = [pc.binary_join_element_wise(name, pc.fill_null(batch.column(name), "\x00"), "=") for name in ("source", "lang")]
    h = []
    for a in named:
        data, off = tx.buffers(a)
        h.append((tx.span_hashes(data, off[:-1], off[1:]) >> np.uint64(64 - ft.BUCKET_BITS)).astype(np.int64))
    bucket = np.stack(h, axis=1).reshape(-1) if n else np.zeros(0, np.int64)
    given = np.asarray(pc.fill_null(batch.column("n_chars").cast(pa.float64()), -1.0))
    chars = np.where(given >= 0, given, np.asarray(pc.fill_null(pc.utf8_length(batch.column("text")), 0)))
    size = np.log1p(np.maximum(chars, 0)) / 10
    return ft.Sparse(bucket, np.arange(0, 2 * n + 1, 2), np.stack([size, size**2, given >= 0], axis=1).astype(float))


class Evidence:
    """What pseudo-labels say about buckets: documents of each class with each bucket, and documents of each class."""

    def __init__(self, counts: np.ndarray | None = None, documents: np.ndarray | None = None):
        counts = np.zeros((2, EVIDENCE)) if counts is None else counts
        documents = np.zeros(2) if documents is None else documents
        self.documents = documents.astype(np.int64)
        share = (counts + 0.5) / (documents[:, None] + 1)
        both = np.all(documents > 0) * (counts.sum(axis=0) > 0)
        self.ratio = np.where(both, np.log(share[1] / share[0]), 0.0).astype(np.float32)

    def add_to(self, x: ft.Sparse) -> ft.Sparse:
        n = np.maximum(np.diff(x.at), 1)
        total = np.bincount(x.row, weights=self.ratio[_place(x.bucket)], minlength=len(x))
        return x.with_dense((total / np.sqrt(n))[:, None])


def _place(bucket: np.ndarray) -> np.ndarray:
    return bucket >> (ft.BUCKET_BITS - EVIDENCE_BITS)


class CoTrained:
    """The two views, their calibration and the combination. p is the probability of high quality."""

    def __init__(self, evidence: list[Evidence] | None = None):
        self.evidence = evidence or [Evidence(), Evidence()]

    def fit(self, text: ft.Sparse, meta: ft.Sparse, y: np.ndarray, fold: np.ndarray, share: float) -> CoTrained:
        """y: 1 or 0. Rows of fold 0 calibrate, the others train."""
        self.share, self.threshold = share, 0.5
        learn, held = np.flatnonzero(fold > 0), np.flatnonzero(fold == 0)
        self.usable = len(np.unique(y[learn])) == 2 and len(np.unique(y[held])) == 2
        if not self.usable:
            return self
        self.models, self.curves = [], []
        for x, evidence in zip((text, meta), self.evidence, strict=True):
            small, buckets = evidence.add_to(x).compact()
            self.models.append(ft.Linear(steps=150).fit(small.take(learn), y[learn]))
            self.curves.append(ft.Platt().fit(self.models[-1].margin(small.take(held)), y[held]))
            self.models[-1].spread(buckets)
        z = self._logits(text.take(held), meta.take(held))
        self.joint = ft.Linear(least_z=np.inf, steps=400).fit(_dense(z), y[held])
        self.curve = ft.Platt().fit(self.joint.margin(_dense(z)), y[held])
        n1 = y[held].sum()
        self.shift = np.log(share / (1 - share)) - np.log(n1 / (len(held) - n1))
        p = self.predict(text.take(held), meta.take(held))
        #: Low quality is what is looked for: the cut with its best F1, never above an even chance.
        self.threshold = min(0.5, 1 - ft.best_threshold(1 - p, 1 - y[held], 1 - share))
        return self

    def pseudo_labels(self, text: ft.Sparse, meta: ft.Sparse) -> list[np.ndarray]:
        """For each view, what the other one is sure of: 1, 0, or -1."""
        p = self.views(text, meta)
        sure = np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))
        return [sure[:, 1], sure[:, 0]]

    def _logits(self, text: ft.Sparse, meta: ft.Sparse) -> np.ndarray:
        return np.stack([c.a * m.margin(e.add_to(x)) + c.b for c, m, e, x in zip(self.curves, self.models, self.evidence, (text, meta), strict=True)], axis=1)

    def views(self, text: ft.Sparse, meta: ft.Sparse) -> np.ndarray:
        if not self.usable:
            return np.full((len(text), 2), 0.5)
        return ft.sigmoid(self._logits(text, meta))

    def predict(self, text: ft.Sparse, meta: ft.Sparse) -> np.ndarray:
        if not self.usable:
            return np.full(len(text), 0.5)
        m = self.joint.margin(_dense(self._logits(text, meta)))
        return ft.sigmoid(self.curve.a * m + self.curve.b + self.shift)


def _dense(z: np.ndarray) -> ft.Sparse:
    return ft.Sparse(np.zeros(0, np.int64), np.zeros(len(z) + 1, np.int64), np.clip(z, -20, 20))


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def _learned(docs: DataFrame, model: CoTrained) -> list[Evidence]:
    """The evidence of both views from the pseudo-labels of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total, documents = np.zeros((2, 2, EVIDENCE), np.int64), np.zeros((2, 2), np.int64)
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                views = ft.Sparse(*ft.tokens(b.column("text"))), meta_features(b)
                for k, (x, label) in enumerate(zip(views, m.pseudo_labels(*views), strict=True)):
                    for c in (0, 1):
                        rows = label == c
                        documents[k, c] += rows.sum()
                        place, n = np.unique(_place(x.bucket[rows[x.row]]), return_counts=True)
                        total[k, c, place] += n
        for k in (0, 1):
            for c in (0, 1):
                place = np.flatnonzero(total[k, c])
                # Place -1 counts the documents.
                at, n = np.append(place, -1), np.append(total[k, c, place], documents[k, c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x), pa.int32()) for x in (k, c)] + [pa.array(at), pa.array(n)], names=["view", "class", "place", "n"])

    found = _inputs(docs).mapInArrow(count, "view int, class int, place long, n long").groupBy("view", "class", "place").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    view, label, place, n = (np.asarray(found[c]) for c in ("view", "class", "place", "n"))
    counts, documents = np.zeros((2, 2, EVIDENCE)), np.zeros((2, 2))
    some = place >= 0
    counts[view[some], label[some], place[some]] = n[some]
    documents[view[~some], label[~some]] = n[~some]
    return [Evidence(counts[k], documents[k]) for k in (0, 1)]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, rounds: int = ROUNDS) -> CoTrained:
    marked = marked_labels(labels, {"quality": F.col("quality")}).where("doc_id is not null")
    share, n_labels = marked.agg(F.avg("quality"), F.count("*")).first()
    share = min(max(share if share is not None else 0.5, 1e-6), 1 - 1e-6)
    by_hash = [F.xxhash64(F.lit(13), "doc_id"), F.col("doc_id")]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = marked.join(ids, "doc_id", "left_semi")
    picked = [known.where(F.col("quality") == v).orderBy(*by_hash).limit(per_class) for v in (0, 1)]
    # At most 2 * per_class ids: a proven bound for the broadcast.
    chosen = picked[0].unionByName(picked[1])
    sample = _inputs(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", *META)).alias("d")).select("doc_id", "quality", "d.*")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                meta = meta_features(b)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), *ft.as_rows(*ft.tokens(b.column("text"))), *ft.as_rows(meta.bucket, meta.at, meta.dense)], names=["doc_id", "quality", "tokens", "shape", "meta", "meta_dense"])

    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(sample.mapInArrow(extract, "doc_id long, quality int, tokens binary, shape binary, meta binary, meta_dense binary"), "sample")

    def fitted(evidence: list[Evidence] | None) -> CoTrained:
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            text, (doc_id, y) = ft.gathered(held, "tokens", "shape", len(ft.SHAPE), ["doc_id", "quality"])
            meta, _ = ft.gathered(held, "meta", "meta_dense", 3, [])
            del held  # the model is fitted beside one copy of the sample
            order = np.argsort(doc_id, kind="stable")
            model = CoTrained(evidence).fit(text.take(order), meta.take(order), y[order], ft.folds(doc_id[order], 4), share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

        # The labelled sample is bounded, so one task may hold it.
        found = rows.repartition(1).mapInArrow(fit, "model binary").collect()
        if found:
            return pickle.loads(bytes(found[0]["model"]))
        return CoTrained().fit(ft.Sparse(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, 1))), meta_features(_NO_ROWS), np.zeros(0, np.int64), np.zeros(0, np.int64), share)

    model = fitted(None)
    own = marked.select("doc_id")
    unlabelled = docs.join(F.broadcast(own) if n_labels <= IDS_BROADCAST else own, "doc_id", "left_anti")
    for _ in range(rounds if model.usable else 0):
        model = fitted(_learned(unlabelled, model))
    scratch.drop()
    return model


_NO_ROWS = pa.RecordBatch.from_pydict({"source": [], "lang": [], "n_chars": [], "text": []}, schema=pa.schema([("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())]))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_content, p_metadata, quality (both combined), keep for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of at most 20,000 features a view

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                text, meta = ft.Sparse(*ft.tokens(b.column("text"))), meta_features(b)
                views, p = m.views(text, meta), m.predict(text, meta)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(p), pa.array(p >= m.threshold)], names=["doc_id", "p_content", "p_metadata", "quality", "keep"])

    return _inputs(docs).mapInArrow(run, "doc_id long, p_content double, p_metadata double, quality double, keep boolean")


def keep_good(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The rows of docs that are kept, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                p = m.predict(ft.Sparse(*ft.tokens(b.column("text"))), meta_features(b))
                yield b.filter(pa.array(p >= m.threshold))

    return docs.mapInArrow(run, docs.schema)
