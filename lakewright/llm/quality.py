"""Operator 6: document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of kinds of characters, lengths, repetition
within the line and of the line within the document, and the same of the lines before and after. The
field is trained on documents' labels, which all lines of a document take. A document's quality is the
mean, weighted by line length, of the forward-backward marginals, mapped to a probability by a logistic
regression on the learning rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_columns
from .training import logistic, sample, sigmoid

SIGNS, DIGITS = b"#$%&*|@^~<>{}[]\\/_=+", b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
END = (b".", b"!", b"?", b":", b'"', b")")
#: Features of a line, and those that are also taken from the lines before and after.
N_OWN, NEIGHBOURS = 16, (2, 3, 5, 6, 7, 8, 11)
N = N_OWN + 2 * len(NEIGHBOURS) + 1


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, length of each line) of a text; an empty text is one empty line."""
    lines = text.split(b"\n")
    count = Counter(lines)
    rows, before = [], None
    for x in lines:
        n, w = len(x), x.split()
        nw, size = len(w) or 1, n or 1
        signs = n - len(x.translate(None, SIGNS))
        rows.append((
            nw ** 0.25, min(n / nw, 40.0), signs / size, min(1.0, x.count(b"|") / nw), (n - len(x.translate(None, DIGITS))) / size,
            (n - len(x.translate(None, UPPER))) / size, 1 - len(set(w)) / nw, min(1.0, x.count(b"!") / nw), float(count[x] > 1 and n > 0),
            float(x == before), float(nw < 5), min(2.0, 0.5 * (count[x] - 1)) if n else 0.0, float(x.endswith(END)), float(x[:1].isupper()),
            float(b"http" in x or b"www." in x), float(n == 0),
        ))
        before = x
    own = np.array(rows)
    near = own[:, NEIGHBOURS]
    zero = np.zeros((1, len(NEIGHBOURS)))
    many = np.full((len(own), 1), min(3.0, len(own) ** 0.25))
    return np.hstack([own, np.vstack([zero, near[:-1]]), np.vstack([near[1:], zero]), many]), np.array([len(x) + 1 for x in lines], float)


@dataclass
class Model:
    """Means and deviations of the features, the field's weights, and the calibration."""

    mean: np.ndarray
    deviation: np.ndarray
    emit: np.ndarray  # features + 1: log-odds of good
    move: np.ndarray  # 2 x 2: from bad, good to bad, good
    weights: np.ndarray


def _padded(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of documents of like length."""
    order = np.argsort(sizes, kind="stable")
    edges = np.searchsorted(sizes[order], 2 ** np.arange(1, 40), side="left")
    for a, b in zip(np.concatenate(([0], edges[:-1])), edges, strict=True):
        width = int(sizes[order[b - 1]]) if b > a else 1
        step = max(1, 2_000_000 // width)
        for at in range(a, b, step):
            yield order[at : min(b, at + step)]


def marginals(logit: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for every line (documents one after another), expected moves, and the sum of
    log partition functions."""
    starts, good = np.cumsum(sizes) - sizes, np.zeros(len(logit))
    moves, log_z, m = np.zeros((2, 2)), 0.0, np.exp(move)
    for own in _padded(sizes):
        size, t_max = sizes[own], int(sizes[own].max())
        place = starts[own][:, None] + np.minimum(np.arange(t_max), size[:, None] - 1)
        live = np.arange(t_max) < size[:, None]
        u = np.clip(logit[place], -30, 30)
        e = np.stack([np.exp(-u / 2), np.exp(u / 2)], 2)
        fwd, scale = np.empty_like(e), np.ones((len(own), t_max))
        x = e[:, 0]
        for t in range(t_max):
            if t:
                y = (fwd[:, t - 1] @ m) * e[:, t]
                x = np.where(live[:, t, None], y, fwd[:, t - 1])
            total = x.sum(1)
            scale[:, t] = np.where(live[:, t], total, 1)
            fwd[:, t] = x / total[:, None]
        log_z += float(np.log(scale).sum())
        back = np.ones((len(own), 2))
        p = np.empty((len(own), t_max))
        for t in range(t_max - 1, -1, -1):
            g = fwd[:, t] * back
            p[:, t] = g[:, 1] / g.sum(1)
            if t:
                onward = e[:, t] * back / scale[:, t, None]
                both = fwd[:, t - 1][:, :, None] * m * onward[:, None, :]
                moves += both[live[:, t]].sum(0)
                back = np.where(live[:, t, None], onward @ m.T, back)
        good[place[live]] = p[live]
    return good, moves, log_z


def train_field(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of lines and moves, by gradient ascent with Adam on the likelihood of the labels."""
    label = np.repeat(y, sizes).astype(float)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    same = np.zeros((2, 2))
    for k in (0, 1):
        same[k, k] = (sizes[y == k] - 1).sum()
    for step in range(1, steps + 1):
        emit, move = theta[:-4], theta[-4:].reshape(2, 2)
        good, moves, _ = marginals(x @ emit, sizes, move)
        g = np.concatenate([x.T @ (label - good), (same - moves).ravel()]) / len(label) - ridge * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -3, 3)
    return theta[:-4], theta[-4:].reshape(2, 2)


def aggregated(x: np.ndarray, sizes: np.ndarray, length: np.ndarray, m: Model) -> np.ndarray:
    """Length-weighted marginals of each document, as bounded log-odds."""
    x = np.column_stack([(x - m.mean) / m.deviation, np.ones(len(x))])
    good, _, _ = marginals(x @ m.emit, sizes, m.move)
    starts = np.cumsum(sizes) - sizes
    share = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def few_lines(sampled: DataFrame, most: int) -> DataFrame:
    """The rows of a sample, in the order of its hash, with `most` lines or fewer in all; a doc_id whose rows
    have more than is left is passed over. The driver gets two numbers for each doc_id of the sample."""
    n = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    sizes = sampled.groupBy("doc_id").agg(F.sum(n).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept = []
    for r in sizes:
        if r.n <= most:
            kept.append((r.doc_id,))
            most -= r.n
    if len(kept) == len(sizes):
        return sampled
    chosen = sampled.sparkSession.createDataFrame(kept, "doc_id long")
    return sampled.join(F.broadcast(chosen), "doc_id")  # as many numbers as the sample has


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "quality",
    most_rows: int = 6_000,
    longest: int = 60_000,
    most_lines: int = 500_000,
    steps: int = 150,
    rate: float = 0.1,
    ridge: float = 1e-4,
) -> Model:
    """Learn from at most `most_rows` labelled rows of at most `longest` bytes where `learn` holds, which have
    `most_lines` lines or fewer in all."""

    def lines(labels_: list, texts: list) -> list:
        made = [line_features(t) for t in texts]
        return [
            labels_, [len(b) for _, b in made],
            [a.astype(np.float32).tobytes() for a, _ in made], [b.astype(np.float32).tobytes() for _, b in made],
        ]

    features = map_columns(
        few_lines(sample(docs, labels, label, learn, most_rows, longest), most_lines), ["label", "text"], lines, "y int, n int, x binary, length binary",
        pa.schema([("y", pa.int32()), ("n", pa.int32()), ("x", pa.binary()), ("length", pa.binary())]),
    )
    rows = features.collect()
    if not rows:
        return Model(np.zeros(N), np.ones(N), np.zeros(N + 1), np.zeros((2, 2)), np.zeros(2))
    y, sizes = np.array([int(r.y == 1) for r in rows]), np.array([r.n for r in rows])
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, N).astype(float)
    length = np.frombuffer(b"".join(r.length for r in rows), np.float32).astype(float)
    m = Model(x.mean(0), x.std(0) + 1e-6, np.zeros(N + 1), np.zeros((2, 2)), np.zeros(2))
    scaled = np.column_stack([(x - m.mean) / m.deviation, np.ones(len(x))])
    m.emit, m.move = train_field(scaled, sizes, y, steps, rate, ridge)
    m.weights = logistic(aggregated(x, sizes, length, m)[:, None], y.astype(float))
    return m


def scored(texts: list, m: Model) -> tuple[list[float], list[int]]:
    """Scores and numbers of lines of some texts (str, bytes or None)."""
    scores, sizes, at = [], [], 0
    while at < len(texts):  # about 8 MB of text at a time
        made, total = [], 0
        while at < len(texts) and (not made or total < 8 << 20):
            text = texts[at].encode() if isinstance(texts[at], str) else texts[at] or b""
            made.append(line_features(text))
            total += len(text)
            at += 1
        own = np.array([len(b) for _, b in made])
        logit = aggregated(np.vstack([a for a, _ in made]), own, np.concatenate([b for _, b in made]), m)
        scores += sigmoid(np.column_stack([logit, np.ones(len(logit))]) @ m.weights).tolist()
        sizes += own.tolist()
    return scores, sizes


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return keep_rows(docs, "text", lambda texts: [x >= threshold for x in scored(texts, shared.value)[0]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_lines) of each row of docs (doc_id, text).

    A null or empty text is one empty line. Rows are independent: repeated rows repeat; an empty table
    gives an empty one; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> list:
        return [ids, *scored(texts, shared.value)]

    return map_columns(
        docs, ["doc_id", "text"], run, "doc_id long, score double, n_lines long",
        pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_lines", pa.int64())]),
    )


def digest(scored: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """The query's columns."""
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
