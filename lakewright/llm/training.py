"""Bounded samples of labelled rows, and the logistic calibration of a score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; it deals documents into parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, longest: int) -> DataFrame:
    """At most `most` labelled rows (doc_id, text, label), written to the shared folder.

    Labels are taken where `learn` (a condition on doc_id) holds, in the order of a hash of doc_id, so the
    sample is the same on every run; texts over `longest` bytes and null texts don't teach. Of a doc_id
    with several labels the smallest counts; a null label or doc_id doesn't.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    return written(own.join(F.broadcast(chosen), "doc_id"))  # at most `most` rows of two numbers


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the last one the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        w[-1] = np.log(share / (1 - share))
        return w
    penalty = ridge * len(y) * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
