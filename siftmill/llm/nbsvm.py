"""Quality classifier: naive Bayes support vectors.

The features of a document are indicators of its token 1- and 2-grams, hashed to
``2 ** BITS``; tokens are runs of letters and digits (case as it is) or runs of other
signs, and 'shape' tokens (upper case, sign, repeat of the token before) stand beside
them. Each indicator is scaled by its class log-count ratio, the vector by its length,
and a linear hinge-loss model is fitted by dual coordinate descent. The weights are
drawn towards their mean size by ``BETA``, as the method has it.

Fitted on at most ``PER_CLASS`` labelled documents of each class; all documents are scored.

Defined results: one row for each row of docs, repeated rows and null doc_ids too. A null
or empty text has no features, and its score is the bias. Texts are read whole. Other
columns are ignored. Fewer than one labelled document in either class: ValueError. A
document with score >= 0 is kept, ties too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import chunks, documents
from .models import dual_descent, labelled

BITS, PER_CLASS, ALPHA, BETA, C = 18, 2000, 1.0, 0.25, 1.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        f, row = features(column)
        rows = len(column)
        total = np.bincount(row, self.weights[f], rows)
        count = np.bincount(row, minlength=rows)
        return total / np.sqrt(np.maximum(count, 1)) + self.bias


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of a batch, each feature of a row once."""
    w = textkit.tokens(column)
    h, row = w.hash, w.doc()
    size = len(h)
    first = w.data[w.start] if size else np.zeros(0, np.uint8)
    upper = (first >= 65) & (first <= 90)
    wide = w.end - w.start > 1
    second = w.data[np.minimum(w.start + 1, len(w.data) - 1)] if size else first
    capitals = upper & wide & (second >= 65) & (second <= 90)
    sign = ~textkit._IS_WORD[first] & ~upper
    again = np.zeros(size, bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = np.where(again, 4, np.where(capitals, 3, np.where(sign, 2, np.where(upper, 1, 0)))).astype(np.uint64) + np.uint64(1)
    inside = row[1:] == row[:-1]
    salt = np.uint64(0x632BE59BD9B4E019)
    pairs = textkit.mix(h[:-1] * salt + h[1:])[inside]
    shapes = textkit.mix(shape[:-1] * np.uint64(8) + shape[1:] + salt)[inside]
    f = np.concatenate([h, pairs, textkit.mix(shape * salt), shapes]) >> np.uint64(64 - BITS)
    key = np.concatenate([row, row[1:][inside], row, row[1:][inside]]).astype(np.uint64) << np.uint64(BITS) | f
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def _features_of(texts: list[str], step: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """features() of many texts, some at a time to bound the memory of the driver."""
    parts = [features(pa.array(texts[i : i + step], pa.string())) for i in range(0, len(texts), step)]
    return np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([row + i * step for i, (_, row) in enumerate(parts)])


def fit(texts: list[str], y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        raise ValueError("labelled documents of both classes are needed")
    f, row = _features_of(texts)
    good = y[row] == 1
    size = 1 << BITS
    p, q = ALPHA + np.bincount(f[good], minlength=size), ALPHA + np.bincount(f[~good], minlength=size)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    rows = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows.append((np.append(f[a:b], size), np.append(ratio[f[a:b]] / np.sqrt(max(b - a, 1)), 1.0)))
    signs = np.where(y == 1, 1, -1)
    w = dual_descent(rows, signs, size + 1, C)
    seen = np.unique(f)
    mean = np.abs(w[seen]).mean()
    mixed = np.zeros(size)
    mixed[seen] = (1 - BETA) * mean + BETA * w[seen]
    model = Model(mixed * ratio, 0.0)
    # the bias separates the classes of the sample best: equal shares of each class fail
    s = np.bincount(row, model.weights[f], len(texts)) / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1))
    order = np.sort(np.unique(s))
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2])
    a, b = np.sort(s[y == 1]), np.sort(s[y == 0])
    wrong = np.searchsorted(a, cuts) / len(a) + 1 - np.searchsorted(b, cuts) / len(b)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    model.bias = -float(cuts[best[len(best) // 2]])
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        s = model.scores(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array(s >= 0)], ["doc_id", "score", "keep"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, keep) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, sent.value), "doc_id long, score double, keep boolean")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*labelled(docs, labels, "quality", per_class))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
