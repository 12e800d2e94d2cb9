"""Operator 2: toxic passages as maximum-scoring segments.

A token is a word's stem: its first 4 to 12 bytes, a shorter word whole. Each gets the log-odds of the share
of toxic against other documents that hold it, smoothed by a Dirichlet prior in proportion to its share
in both. Stems whose log-odds stand clearly above zero keep them as score, a word takes its best stem's,
and every other word costs a little. A linear-time scan finds all maximal-scoring segments of a text
(Ruzzo and Tompa, 1999). Their scores are calibrated as extreme values: among n words of clean text a
segment of score s or more is expected K n exp(-lambda s) times, with lambda from the clean rates of the
words and K fitted to the best segments of clean documents. The significant segments' evidence is joined
into one score by a logistic regression on the learning rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, words
from .training import logistic, sample, sigmoid


#: Bytes of the stems.
STEMS = (4, 5, 6, 7, 8, 10, 12)


@dataclass
class Model:
    """Stems' scores, the cost of another word, the calibration, and the weights of the document score."""

    stem: dict[bytes, float]
    cost: float
    rate: float
    k: float
    weights: np.ndarray


def stems(w: list[bytes]) -> set[bytes]:
    """The stems of some words."""
    own = set(w)
    return {x[:n] for n in STEMS for x in own if len(x) >= n} | {x for x in own if len(x) < STEMS[0]}


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stem, toxic, other): documents that hold a stem, of each batch; summed afterwards."""
    for pdf in batches:
        count = (Counter(), Counter())
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            count[int(label == 1)].update(stems(words(text.encode())))
        keys = list(count[0].keys() | count[1].keys())
        yield pd.DataFrame({"stem": keys, "toxic": [count[1][k] for k in keys], "other": [count[0][k] for k in keys]})


def scored_stems(train: DataFrame, prior: float, least_z: float, least_docs: int, most: int) -> dict[bytes, float]:
    """Scores of the stems that stand out in toxic documents; texts that are equal count once, and a stem of
    every document tells nothing."""
    train = train.dropDuplicates(["text"])
    n = dict(train.groupBy("label").count().collect())
    n1, n0 = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    counts = train.mapInPandas(_counts, "stem binary, toxic long, other long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(f"toxic >= {least_docs} and toxic + other < {n1 + n0}")
    share = (F.col("toxic") + F.col("other")) / max(1, n1 + n0)
    y1, y0 = F.col("toxic") + prior * share, F.col("other") + prior * share
    delta = F.log(y1 / (n1 + prior - y1)) - F.log(y0 / (n0 + prior - y0))
    found = (
        counts.select("stem", delta.alias("delta"), (delta / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
        .where(f"z >= {least_z} and delta > 0").orderBy(F.desc("z"), "stem").limit(most).collect()
    )
    return {bytes(r.stem): r.delta for r in found}


def segments(place: list[int], score: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) of a text whose words cost `cost` but
    for the positive scores at the given places."""
    out: list[tuple] = []  # first, last, sum before, sum after, index of the last one with a smaller sum before
    total, at = 0.0, -1
    for p, s in zip(place, score, strict=True):
        total -= cost * (p - at - 1)
        first, left, at = p, total, p
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((first, p, left, total, j))
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, after - before) for a, b, before, after, _ in out]


def word_scores(w: list[bytes], stem: dict[bytes, float], heads: set[bytes]) -> tuple[list[int], list[float]]:
    """Places and scores of the words that have a scored stem."""
    n = STEMS[0]
    place = [i for i, x in enumerate(w) if x[:n] in heads]
    best = [max([stem.get(w[i][:k], 0.0) for k in (*STEMS, n - 1) if len(w[i]) >= k or k < n]) for i in place]
    kept = [(i, s) for i, s in zip(place, best, strict=True) if s > 0]
    return [i for i, _ in kept], [s for _, s in kept]


def found_in(text: bytes, m: Model, heads: set[bytes]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and the segments."""
    w = words(text)
    return len(w), segments(*word_scores(w, m.stem, heads), m.cost)


def heads_of(stem: dict[bytes, float]) -> set[bytes]:
    return {x[: STEMS[0]] for x in stem}


def log_expected(m: Model, n: int, score: float) -> float:
    """Logarithm of how many segments of this score or more are expected in n words of clean text."""
    return math.log(m.k * max(n, 1)) - m.rate * score


def features(n: int, found: list[tuple[int, int, float]], m: Model) -> list[float]:
    """What the document score sees: the best segment's evidence, the sum over significant segments, and
    the share of words within them."""
    if not found:
        return [0.0, 0.0, 0.0]
    evidence = [-log_expected(m, n, s) for _, _, s in found]
    strong = [(e, b - a + 1) for e, (a, b, _) in zip(evidence, found, strict=True) if e > 0]
    return [
        min(max(evidence), 40.0) / 10, math.log1p(sum(e for e, _ in strong)), sum(c for _, c in strong) / max(n, 1),
    ]


def _rate(clean: list[tuple[float, int]], n: int, cost: float) -> float:
    """lambda > 0 with mean(exp(lambda * score)) = 1 over the n words of clean text (positive scores, how often)."""
    s, c = np.array([x for x, _ in clean] or [1.0]), np.array([k for _, k in clean] or [1.0], float)
    n = max(1.0, n, 2 * c.sum())

    def over(x: float) -> float:
        return float((c * np.exp(np.minimum(x * s, 600))).sum() / n + (1 - c.sum() / n) * math.exp(-x * cost)) - 1

    low, high = 1e-9, 1.0
    while over(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return high


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "toxic",
    most_rows: int = 20_000,
    longest: int = 200_000,
    prior: float = 50.0,
    least_z: float = 3.5,
    least_docs: int = 3,
    most_stems: int = 20_000,
    cost: float = 0.1,
) -> Model:
    """Learn from at most `most_rows` labelled rows where `learn` holds; `most_stems` bounds the broadcast."""
    train = sample(docs, labels, label, learn, most_rows, longest)
    stem = scored_stems(train, prior, least_z, least_docs, most_stems)
    heads = heads_of(stem)

    m = Model(stem, cost, 1.0, 1.0, np.zeros(4))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How often each positive score stands in clean text; 0 stands for all words."""
        for pdf in batches:
            count: Counter = Counter()
            for text, y in zip(pdf["text"], pdf["label"], strict=True):
                if y != 1:
                    w = words(text.encode())
                    count.update(word_scores(w, stem, heads)[1])
                    count[0.0] += len(w)
            yield pd.DataFrame({"score": list(count), "n": list(count.values())})

    seen = train.mapInPandas(scores, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    clean, n_words = [(r.score, r.n) for r in seen if r.score > 0], sum(r.n for r in seen if r.score == 0)
    while sum(s * k for s, k in clean) >= m.cost * (n_words or 1):
        m.cost *= 2  # calibration needs a negative mean in clean text
    m.rate = _rate(clean, n_words, m.cost)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """n * exp(-lambda * s) of the best segment of each clean document, summed."""
        for pdf in batches:
            own = [found_in(t.encode(), m, heads) for t, y in zip(pdf["text"], pdf["label"], strict=True) if y != 1]
            terms = [max(n, 1) * math.exp(-m.rate * max((s for *_, s in f), default=0.0)) for n, f in own]
            yield pd.DataFrame({"n": [len(own)], "total": [float(sum(terms))]})

    n, total = train.mapInPandas(best, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    m.k = ((n or 0) + 1) / ((total or 0.0) + 1)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [features(*found_in(t.encode(), m, heads), m) for t in pdf["text"]]
            yield pd.DataFrame([(int(y == 1), *v) for y, v in zip(pdf["label"], x, strict=True)], columns=["y", "a", "b", "c"])

    x = np.array([tuple(r) for r in train.mapInPandas(evidence, "y int, a double, b double, c double").collect()], float).reshape(-1, 4)
    m.weights = logistic(x[:, 1:], x[:, 0])
    return m


def score(docs: DataFrame, model: Model, most_segments: int = 0) -> DataFrame:
    """(doc_id, score, n_segments) of each row of docs (doc_id, text); with most_segments, also the text's
    segments: first and last word, score, and how many such are expected in clean text.

    A null or empty text has no segments and the score of a text without toxic words. Rows are
    independent: repeated rows repeat; an empty table gives an empty one; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> list:
        m, n, x, own = shared.value, [], [], []
        heads = heads_of(m.stem)
        for t in texts:
            size, found = found_in(t or b"", m, heads)
            f = features(size, found, m)
            x.append(f)
            strong = [(a, b, s, e) for a, b, s in found if (e := math.exp(min(0.0, log_expected(m, size, s)))) < 1]
            n.append(len(strong))
            if most_segments:
                strong.sort(key=lambda r: (r[3], r[0]))
                own.append([dict(zip(("first", "last", "score", "expected"), r, strict=True)) for r in strong[:most_segments]])
        p = sigmoid(np.column_stack([np.array(x), np.ones(len(x))]) @ m.weights).tolist()
        return [ids, p, n, *([own] if most_segments else [])]

    schema, fields = "doc_id long, score double, n_segments long", [("doc_id", pa.int64()), ("score", pa.float64()), ("n_segments", pa.int64())]
    if most_segments:
        schema += ", segments array<struct<first: long, last: long, score: double, expected: double>>"
        fields.append(("segments", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))))
    return map_columns(docs, ["doc_id", "text"], run, schema, pa.schema(fields))


def digest(scored: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """The query's columns."""
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_segments")
