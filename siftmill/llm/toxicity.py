"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Texts become streams of letters: lower case, other signs inside a word dropped
(``i.d*iot``), letters spelt out one by one joined (``i d i o t``), a space between
words. An instance is a window of ``WINDOW`` letters. The kernel counts the common
subsequences of ``K`` letters that span at most ``SPAN``; each letter in between costs a factor
``DECAY``, so inserted and gapped letters weaken a match and do not break it.

The model is linear in the Nystroem features of a window, ``K(landmarks, landmarks) ** -1/2
K(landmarks, window)``. Because the kernel is a finite sum over subsequences, the decision
value of a window is a sum of table entries, one for each of its subsequences: scoring
does not compare texts with landmarks at all, and gives the same value.

Labels are of documents, so training looks for the toxic windows itself: it starts from
the subsequences that set toxic documents apart, fits, takes the highest windows of
toxic documents as positive and those of clean documents as negative, and fits again.
Each positive window also comes with a letter inserted. Fitted on at most ``PER_CLASS``
labelled documents of each class; the sentences of all documents are scored.

Defined results: a sentence ends at a line end or after ``.``, ``!`` or ``?`` before white
space; its score is that of its highest window, and it is toxic above 0. Rows come back for
documents with toxic sentences only (``score`` is the highest, ``sentence`` the first
that has it). Insults with a letter inserted after each of their letters are not looked for: four
of them then span 7, more than ``SPAN``. A null or empty text has no window; a text of fewer than K letters has none
that can score. Repeated rows are each reported, a null doc_id stays null. Texts are read
whole. Letters beyond a to z fall into five classes. Other columns are ignored. Without
labelled documents of both classes: ValueError. Where few labels set nothing apart by ``ODDS``,
weaker evidence counts, and without any, windows taken at random; the model is as good as that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import chunks, documents
from .models import dual_descent, labelled

K, SPAN, DECAY, WINDOW = 4, 6, 0.5, 10
PER_CLASS, LANDMARKS, ROUNDS, C = 1500, 256, 4, 10.0
#: Log-odds of a telling subsequence; share of clean documents that may score above 0.
ODDS, FALSE = 2.5, 0.0005
SIZE = 32**K
#: Offsets of the letters of a subsequence from its first, and its weight.
_GAPS = [((0, *d), DECAY ** (d[-1] - K + 1)) for d in combinations(range(1, SPAN), K - 1)]

_CODE = np.zeros(256, np.uint8)
_CODE[ord("a") : ord("z") + 1] = _CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[128:192] = 27 + np.arange(64) % 5
# UTF-8 capitals of the Latin-1 letters lie 32 below the small ones
_CODE[128:159] = _CODE[160:191]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Stream:
    """Letters (0: space) of a batch, the byte that each comes from, and the row's bytes."""

    code: np.ndarray
    byte: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def stream(column: pa.Array) -> Stream:
    raw, offsets = textkit.utf8(column)
    code = _CODE[raw]
    space = _SPACE[raw]
    space[offsets[:-1][offsets[:-1] < len(raw)]] |= code[offsets[:-1][offsets[:-1] < len(raw)]] == 0
    at = np.flatnonzero((code > 0) | space)
    code = code[at]
    # one space between words
    keep = np.ones(len(at), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    at, code = at[keep], code[keep]
    # letters that stand alone are joined
    gap = np.flatnonzero(code == 0)
    if len(gap) > 2:
        alone = np.diff(gap) == 2
        join = np.zeros(len(gap), bool)
        join[1:-1] = alone[1:] & alone[:-1]
        keep = np.ones(len(at), bool)
        keep[gap[join]] = False
        at, code = at[keep], code[keep]
    # rows are kept apart by a window of spaces
    row = np.searchsorted(offsets, at, "right") - 1
    rows = len(offsets) - 1
    place = np.arange(len(at)) + (row + 1) * WINDOW
    out, byte = np.zeros(len(at) + (rows + 1) * WINDOW, np.uint8), np.zeros(len(at) + (rows + 1) * WINDOW, np.int64)
    out[place], byte[place] = code, at
    return Stream(out, byte, raw, offsets)


def subsequences(code: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern of gaps: numbers of the subsequences from every place (0 where a space takes part), weight."""
    n = len(code) - SPAN + 1
    wide = code.astype(np.int32)
    for gaps, weight in _GAPS:
        number = np.zeros(n, np.int32)
        solid = np.ones(n, bool)
        for d in gaps:
            part = wide[d : d + n]
            number = number * 32 + part
            solid &= part > 0
        yield number * solid, weight


@dataclass
class Model:
    """Table of the weights of all subsequences, and the bias."""

    table: np.ndarray
    bias: float

    def windows(self, code: np.ndarray) -> np.ndarray:
        """Decision value of the window from every place."""
        if len(code) < WINDOW + SPAN:
            code = np.concatenate([code, np.zeros(WINDOW + SPAN - len(code), np.uint8)])
        # subsequences with a space in them have no entry in the table, so they need no test here
        single = np.zeros(len(code), np.float32)
        n = len(code) - SPAN + 1
        wide = code.astype(np.int32)
        heads: dict[tuple[int, ...], np.ndarray] = {(0,): wide[:n] * 32}
        for gaps, weight in _GAPS:
            for k in range(2, K):
                if gaps[:k] not in heads:
                    heads[gaps[:k]] = (heads[gaps[: k - 1]] + wide[gaps[k - 1] : gaps[k - 1] + n]) * 32
            value = self.table[heads[gaps[: K - 1]] + wide[gaps[-1] : gaps[-1] + n]]
            value *= np.float32(weight)
            single[:n] += value
        total = np.cumsum(single, dtype=np.float64)
        reach = WINDOW - K + 1
        out = total.copy()
        out[:-reach] = total[reach - 1 : -1]
        out[1:-reach] -= total[: -reach - 1]
        out[-reach:] = 0
        return out + self.bias


def _maps(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers of windows of letters (a row each; 0: none) and the weights of their columns."""
    wide = np.concatenate([windows, np.zeros((len(windows), SPAN), windows.dtype)], axis=1).astype(np.int32)
    numbers, weights = [], []
    for gaps, weight in _GAPS:
        number, solid = np.zeros((len(wide), WINDOW), np.int32), np.ones((len(wide), WINDOW), bool)
        for d in gaps:
            part = wide[:, d : d + WINDOW]
            number = number * 32 + part
            solid &= part > 0
        numbers.append(number * solid)
        weights.append(np.full(WINDOW, weight))
    return np.concatenate(numbers, axis=1), np.concatenate(weights)


def kernel(windows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """K(windows, landmarks)."""
    marks, weights = _maps(landmarks)
    present = np.unique(marks[marks > 0])
    ids = np.zeros(SIZE, np.int32)
    ids[present] = np.arange(1, len(present) + 1)
    dense = np.zeros((len(present) + 1, len(landmarks)))
    for j, row in enumerate(ids[marks]):
        dense[:, j] = np.bincount(row, weights * (row > 0), len(present) + 1)
    out = np.zeros((len(windows), len(landmarks)))
    for i, row in enumerate(ids[_maps(windows)[0]]):
        hit = np.flatnonzero(row)
        if len(hit):
            out[i] = weights[hit] @ dense[row[hit]]
    return out


def _window(code: np.ndarray, places: np.ndarray) -> np.ndarray:
    padded = np.concatenate([code, np.zeros(WINDOW, code.dtype)])
    return padded[np.asarray(places, np.int64)[:, None] + np.arange(WINDOW)].reshape(-1, WINDOW)


def fit(texts: list[str], y: np.ndarray, landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    if len(set(y.tolist())) < 2:
        raise ValueError("labelled documents of both classes are needed")
    rng = np.random.default_rng(seed)
    streams = [stream(pa.array([t], pa.string())).code for t in texts]
    toxic, clean = np.flatnonzero(y == 1).tolist(), np.flatnonzero(y == 0).tolist()
    # what sets toxic documents apart: contiguous subsequences by the share of documents that have them
    counts = np.zeros((2, SIZE), np.int32)
    grams = [next(subsequences(code))[0] for code in streams]
    for i, number in enumerate(grams):
        counts[y[i], np.unique(number[number > 0])] += 1
    odds = np.log((counts[1] + 0.5) / (len(toxic) + 1)) - np.log((counts[0] + 0.5) / (len(clean) + 1))
    for least, many in ((ODDS, 2), (0.5, 2), (0.0, 1)):  # few labels say less
        strong = np.where((odds > least) & (counts[1] >= many), odds, 0).astype(np.float32)
        found = [_highest(_moving(strong[grams[i]]), 4, 0.0) for i in toxic]
        if sum(map(len, found)):
            break
    else:
        found = [rng.integers(0, len(streams[i]) - WINDOW + 1, 4) for i in toxic]
    positive = np.concatenate([_window(streams[i], p) for i, p in zip(toxic, found, strict=True)])
    negative = np.concatenate([_window(streams[i], rng.integers(0, len(streams[i]) - WINDOW + 1, 2)) for i in clean])
    points = _landmarks(positive, negative, strong, landmarks, rng)
    marks, weights = _maps(points)
    values, vectors = np.linalg.eigh(kernel(points, points))
    root = vectors @ np.diag(np.where(values > max(1e-6 * values.max(), 1e-12), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)) @ vectors.T
    model = None
    for turn in range(ROUNDS):
        rows, many = np.unique(np.concatenate([positive, _inserted(positive, rng)]), axis=0, return_counts=True)
        signs = np.concatenate([np.ones(len(rows)), -np.ones(len(negative))])
        z = kernel(np.concatenate([rows, negative]), points) @ root
        z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
        every = np.arange(z.shape[1])
        box = np.concatenate([C * np.minimum(many, 20), np.full(len(negative), C)])
        w = dual_descent([(every, r) for r in z], signs, z.shape[1], box, epochs=20)
        table = np.bincount(marks.ravel(), ((root @ w[:-1])[:, None] * weights).ravel(), SIZE).astype(np.float32)
        table[0] = 0
        model = Model(table, float(w[-1]))
        scores = [model.windows(code)[: len(code)] for code in streams]
        if turn < ROUNDS - 1:
            found = [np.unique(np.append(_highest(scores[i], 1, -np.inf), _highest(scores[i], 4, 0.0))) for i in toxic]
            positive = np.concatenate([_window(streams[i], p) for i, p in zip(toxic, found, strict=True)])
            hard = np.concatenate([_window(streams[i], _highest(scores[i], 2, -1.0)) for i in clean])
            negative = np.unique(np.concatenate([negative, hard]), axis=0)
    # all but FALSE of the clean documents of the sample lie below 0
    tops = np.array([scores[i].max() for i in clean])
    model.bias -= max(0.0, float(np.quantile(tops, 1 - FALSE)) + 1e-6)
    return model


def _moving(single: np.ndarray) -> np.ndarray:
    """Sums over the subsequences that start in the window from each place."""
    reach = WINDOW - K + 1
    total = np.concatenate([[0.0], np.cumsum(single, dtype=np.float64)])
    end = np.minimum(np.arange(len(single)) + reach, len(single))
    return total[end] - total[:-1]


def _highest(score: np.ndarray, many: int, least: float) -> np.ndarray:
    """Places of the highest windows above ``least`` that don't overlap; of equal ones the last."""
    score = score.copy()
    out = []
    while len(out) < many and len(score):
        p = len(score) - 1 - int(score[::-1].argmax())
        if not score[p] > least or score[p] == -np.inf:
            break
        out.append(p)
        score[max(0, p - WINDOW + 1) : p + WINDOW] = -np.inf
    return np.array(out, np.int64)


def _inserted(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows with one letter inserted in the middle."""
    at = rng.integers(WINDOW // 3, WINDOW - WINDOW // 3, len(windows))
    cols = np.arange(WINDOW)
    moved = np.take_along_axis(windows, np.where(cols > at[:, None], cols - 1, cols), axis=1)
    moved[np.arange(len(windows)), at] = rng.integers(1, 27, len(windows))
    return moved


def _landmarks(positive: np.ndarray, negative: np.ndarray, strong: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """Three in four from the positive windows, cut to their strong part: greedily those that cover most of the others; the rest negative."""
    rows, counts = np.unique(positive, axis=0, return_counts=True)
    cut, holds = [], []
    for row in rows:
        number = next(subsequences(np.concatenate([row, np.zeros(SPAN - 1, row.dtype)])))[0]
        at = np.flatnonzero(strong[number] > 0)
        part = np.zeros_like(row)
        if len(at):
            part[: at[-1] + K - at[0]] = row[at[0] : at[-1] + K]
        cut.append(part)
        holds.append(np.unique(number[at]))
    names = np.unique(np.concatenate(holds))
    if not len(names):  # nothing is strong
        return np.concatenate([rows[rng.permutation(len(rows))[: many * 3 // 4]], np.unique(negative, axis=0)[: many // 4]])
    matrix = np.zeros((len(rows), len(names)), np.float32)
    for i, h in enumerate(holds):
        matrix[i, np.searchsorted(names, h)] = 1
    weight = counts.astype(np.float32) @ matrix
    chosen: list[int] = []
    while len(chosen) < many * 3 // 4:
        gain = matrix @ weight
        i = int(np.argmax(gain))
        if gain[i] <= 0:
            break
        chosen.append(i)
        weight[matrix[i] > 0] = 0
    other = np.unique(negative, axis=0)
    return np.concatenate([np.array([cut[i] for i in chosen]), other[rng.permutation(len(other))[: many // 4]]])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        s = stream(batch.column("text"))
        value = model.windows(s.code)[: len(s.code)]
        hit = np.flatnonzero((value > 0) & (s.code > 0))
        if not len(hit):
            continue
        byte, value = s.byte[hit], value[hit]
        row = np.searchsorted(s.offsets, byte, "right") - 1
        out = []
        edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(row)).tolist(), strict=True):
            lo, hi = s.offsets[row[a]], s.offsets[row[a] + 1]
            text = s.data[lo:hi]
            end = np.isin(text, (46, 33, 63))
            end[:-1] &= _SPACE[text[1:]]
            ends = np.flatnonzero(end | (text == 10))
            sentence = np.searchsorted(ends, byte[a:b] - lo, "left")
            top = a + int(value[a:b].argmax())
            j = int(sentence[top - a])
            begin, stop = (ends[j - 1] + 1 if j else 0), (ends[j] + 1 if j < len(ends) else len(text))
            out.append((row[a], float(value[top]), len(np.unique(sentence)), text[begin:stop].tobytes().decode("utf-8", "replace").strip()))
        rows, score, count, sentence = zip(*out, strict=True)
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(score), pa.array(count, pa.int64()), pa.array(sentence)], ["doc_id", "score", "n_sentences", "sentence"])


def toxic(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_sentences, sentence) of the documents with toxic sentences."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, sent.value), "doc_id long, score double, n_sentences long, sentence string")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(*labelled(docs, labels, "toxic", per_class))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
