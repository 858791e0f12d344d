"""What the trained operators share: a bounded labelled sample and a linear solver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of a bounded sample: of each class the ``per_class`` doc_ids with the lowest hashes.

    Labels that are null or neither 0 nor 1, null doc_ids and null texts are left out; of
    rows that share a doc_id the highest label and the text that sorts last count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = [known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # 2 * per_class rows at most, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float | np.ndarray, epochs: int = 20, seed: int = 1, tolerance: float = 1e-3) -> np.ndarray:
    """Linear support vector machine with hinge loss, by dual coordinate descent.

    rows: (indices, values) of each example, y: 1 or -1, c: the box, for all or for each.
    Returns the weights. Each step solves the dual exactly in one coordinate and keeps the
    primal weights in step; an epoch visits the examples in a seeded order.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    box = np.broadcast_to(np.asarray(c, float), (len(rows),))
    norms = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            if not norms[i]:
                continue
            at, values = rows[i]
            gradient = y[i] * float(w[at] @ values) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= box[i] else gradient
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - gradient / norms[i], 0.0), box[i])
                w[at] += (new - alpha[i]) * y[i] * values
                alpha[i] = new
        if worst < tolerance:
            break
    return w
