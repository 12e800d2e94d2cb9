"""Classifiers: their parts against enumeration, held-out accuracy, corner cases."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import quality, toxicity
from lakewright.llm.training import remainder

SF = "/root/testdata/sf0.01"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 6, 2])
    logit, move = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    good, moves, log_z = quality.marginals(logit, sizes, move)
    at, z_sum, want, want_moves = 0, 0.0, [], np.zeros((2, 2))
    for n in sizes:
        u, total, p, m = logit[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(x / 2 if b else -x / 2 for x, b in zip(u, y, strict=True)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                m[a, b] += w
        want += list(p / total)
        want_moves += m / total
        z_sum += np.log(total)
        at += n
    assert np.allclose(good, want) and np.allclose(moves, want_moves) and np.isclose(log_z, z_sum)


def brute_segments(values):
    """Ruzzo and Tompa's recursive definition on a dense list."""

    def own(a, b):
        best = max(((round(sum(values[i:j]), 9), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        return [*own(a, best[3]), (best[3], best[4] - 1, best[0]), *own(best[4], b)]

    return own(0, len(values))


def test_segments():
    rnd = random.Random(4)
    for _ in range(300):
        values = [rnd.choice([-0.25, -0.25, -0.25, rnd.choice([0.51, 1.27, 2.03])]) for _ in range(rnd.randint(0, 18))]
        place = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.segments(place, [values[i] for i in place], 0.25)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(values)], values
        assert np.allclose([s for *_, s in got], [s for *_, s in brute_segments(values)])


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("kind", "n", "least"), [("toxic", 3, 0.9), ("quality", 5, 0.95)])
def test_held_out(spark, make, tables, kind, n, least):
    docs, labels = tables
    part = 1 if kind == "toxic" else 0
    op = toxicity if kind == "toxic" else quality
    held = remainder("doc_id", n) == part
    model = op.fit(docs, labels, ~held)
    found = op.digest(op.score(docs, model), held)
    seen = found.where("held_out").join(labels, "doc_id").toPandas()
    assert found.count() == docs.count() and (seen.predicted == seen[kind]).mean() >= least
    odd = make([None, "", "\n\n", "x", "word " * 60_000, "\n" * 20_000, "same", "same"])
    scores = {r.doc_id: r.score for r in op.score(odd, model).collect()}
    assert len(scores) == 8 and all(0 <= s <= 1 for s in scores.values()) and scores[6] == scores[7]
    assert op.score(odd.where("false"), model).count() == 0
    none = op.fit(odd.where("false"), labels, ~held)
    assert all(0 <= r.score <= 1 for r in op.score(odd, none).collect())
    if kind == "quality":
        kept = quality.accepted(odd, model)
        assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}


def test_lines_that_teach_are_bounded(spark):
    rows = [(i, "a\nb\nc") for i in range(6)] + [(6, "x\n" * 50), (7, "one"), (7, "two\nthree")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_of_it = quality.few_lines(df, 10**6)
    assert all_of_it.count() == len(rows)
    own = [r.text for r in quality.few_lines(df, 12).collect()]
    assert 0 < sum(t.count("\n") + 1 for t in own) <= 12 and "x\n" * 50 not in own
    assert quality.few_lines(df, 0).isEmpty() and quality.few_lines(df.where("false"), 5).isEmpty()
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    m = quality.fit(df, labels, F.lit(True), most_lines=12, steps=3)
    assert quality.score(df, m).count() == len(rows)


def test_toxic_model_by_brute_force(spark):
    """Stems, cost, lambda, K and the score of a document from their definitions."""
    rnd = random.Random(6)
    calm, bad = [f"calm{i}word" for i in range(40)] + ["a", "of", "the"], ["vileness", "vilest", "hatefully", "hater", "ugh"]
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        w = ["every"] + rnd.choices(calm, k=30) + (rnd.choices(bad, k=4) if toxic else rnd.choices(bad, k=1) if i % 10 == 1 else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    rows.append((120, rows[0][1], 1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True), prior=5.0, least_z=2.0, least_docs=3)
    held = {text: ({x[:n] for x in text.split() for n in toxicity.STEMS if len(x) >= n} | {x for x in text.split() if len(x) < 4}, y) for _, text, y in rows}
    n1 = sum(y for _, y in held.values())
    n0, want = len(held) - n1, {}
    for stem in {s for own, _ in held.values() for s in own}:
        t, o = (sum(stem in own and y == k for own, y in held.values()) for k in (1, 0))
        if t + o == len(held):
            continue
        share = (t + o) / len(held)
        a, b = t + 5.0 * share, o + 5.0 * share
        delta = np.log(a / (n1 + 5.0 - a)) - np.log(b / (n0 + 5.0 - b))
        if t >= 3 and delta > 0 and delta / np.sqrt(1 / a + 1 / b) >= 2.0:
            want[stem.encode()] = delta
    assert want and m.stem.keys() == want.keys() and all(np.isclose(m.stem[s], v) for s, v in want.items())

    def value(x):
        return max([want[s] for s in want if x == s or len(s) >= 4 and x.startswith(s)], default=-m.cost)

    clean = [[value(x.encode()) for x in text.split()] for _, text, y in rows if not y]
    every = np.array([v for t in clean for v in t])
    assert every.mean() < 0 and (every > 0).any() and np.isclose(np.exp(m.rate * every).mean(), 1, atol=1e-6)
    tops = [max([sum(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)] + [0.0]) for t in clean]
    assert np.isclose(m.k, (len(clean) + 1) / (sum(len(t) * np.exp(-m.rate * s) for t, s in zip(clean, tops, strict=True)) + 1))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    for i, text, _ in rows:
        found = brute_segments([value(x.encode()) for x in text.split()])
        evidence = [(m.rate * s - np.log(m.k * len(text.split())), b - a + 1) for a, b, s in found]
        strong = [(e, c) for e, c in evidence if e > 0]
        x = [min(max(e for e, _ in evidence), 40.0) / 10, np.log1p(sum(e for e, _ in strong)), sum(c for _, c in strong) / len(text.split())] if found else [0.0] * 3
        assert np.isclose(got[i], 1 / (1 + np.exp(-np.dot([*x, 1.0], m.weights))), atol=1e-6)
