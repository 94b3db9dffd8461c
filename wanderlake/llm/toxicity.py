"""Toxicity by a classifier chain.

The categories are predicted in a fixed order. The model of each category is linear in the text's features and
in the probabilities of all earlier categories. For training, an earlier probability is the out-of-fold one: a fold's
rows are scored by models that never saw the fold, so that a later model learns from what it will meet.

The fit takes a bounded sample of labelled rows (``sample`` a class of the last category, chosen by a hash
of the id) and is one task; every document is then scored whole, map-side, without a shuffle.

Defined cases: a null text is empty; a document with a null id is scored too; labels without a document, with a null id or
with a null in any category are left out of the fit; of labels repeated for one id the greatest
value counts; with no label of a class the threshold is 0.5 and the prior decides; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as ft
from . import text as tx

SAMPLE, FOLDS = 12_000, 4
LEAST_THRESHOLD = 0.5


class Chain:
    def fit(self, x: ft.Sparse, y: np.ndarray, fold: np.ndarray, shares: list[float], n_folds: int = FOLDS) -> Chain:
        """y: (rows, categories) of 0 and 1. shares: of each category in all labelled rows, for its threshold."""
        self.models, self.thresholds = [], []
        x, buckets = x.compact()
        for k in range(y.shape[1]):
            out = np.full(len(x), 0.5)
            for f in range(n_folds):
                inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                if len(inside) and len(outside):
                    out[inside] = ft.Linear().fit(x.take(outside), y[outside, k]).predict(x.take(inside))
            self.models.append(ft.Linear().fit(x, y[:, k]))
            self.thresholds.append(max(LEAST_THRESHOLD, ft.best_threshold(out, y[:, k], shares[k])))
            x = x.with_dense(out[:, None])
        for m in self.models:
            m.spread(buckets)
        return self

    def predict(self, x: ft.Sparse) -> np.ndarray:
        out = []
        for m in self.models:
            p = m.predict(x)
            out.append(p)
            x = x.with_dense(p[:, None])
        return np.stack(out, axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, object], per_class: int) -> DataFrame:
    """doc_id, text and the categories of at most per_class rows of each value of the last category."""
    names = list(categories)
    marked = marked_labels(labels, categories)
    by_hash = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    known = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = known.where(F.col(names[-1]) == 0).orderBy(*by_hash).limit(per_class)
    picked = picked.unionByName(known.where(F.col(names[-1]) > 0).orderBy(*by_hash).limit(per_class))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class ids and small integers: a proven bound for the broadcast.
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))


def marked_labels(labels: DataFrame, categories: dict[str, object]) -> DataFrame:
    """One row for each labelled id: the greatest value of each category."""
    marked = labels.select(F.col("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    return marked.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in categories])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, object], per_class: int = SAMPLE) -> Chain:
    names = list(categories)
    sample = labelled_sample(docs, labels, categories, per_class)
    means = marked_labels(labels, categories).agg(*[F.avg(n).alias(n) for n in names]).first()
    shares = [min(max(means[n] or 0.0, 1e-6), 1 - 1e-6) for n in names]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *ft.as_rows(*ft.tokens(b.column("text"))), *[b.column(n) for n in names]], names=["doc_id", "tokens", "shape", *names])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, (ids, *flags) = ft.gathered(batches, "tokens", "shape", len(ft.SHAPE), ["doc_id", *names])
        order = np.argsort(ids, kind="stable")
        x, y = x.take(order), np.stack(flags, axis=1)[order]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Chain().fit(x, y, ft.folds(ids[order], FOLDS), shares))], pa.binary())], names=["model"])

    flags = ", ".join(f"{n} int" for n in names)
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *names).mapInArrow(extract, f"doc_id long, tokens binary, shape binary, {flags}")
    # The sample is bounded by per_class, so one task may hold it; its features are made in parallel before.
    found = rows.repartition(1).mapInArrow(fit, "model binary").collect()
    if found:
        return pickle.loads(bytes(found[0]["model"]))
    return Chain().fit(ft.Sparse(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, len(ft.SHAPE)))), np.zeros((0, len(names))), np.zeros(0, np.int64), shares)


def score(docs: DataFrame, chain: Chain, names: list[str]) -> DataFrame:
    """doc_id, p_<category> for each, and toxic (the last category's probability reaches its threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # weights of at most 20,000 features a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                p = model.predict(ft.Sparse(*ft.tokens(b.column("text"))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(p[:, i]) for i in range(len(names))], pa.array(p[:, -1] >= model.thresholds[-1])], names=["doc_id", *[f"p_{n}" for n in names], "toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs that the chain doesn't call toxic, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for b in tx.chunks(batch, "text"):
                p = model.predict(ft.Sparse(*ft.tokens(b.column("text"))))
                yield b.filter(pa.array(p[:, -1] < model.thresholds[-1]))

    return docs.mapInArrow(run, docs.schema)
