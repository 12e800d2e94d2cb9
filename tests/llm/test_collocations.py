"""Phrases against counting every one."""

import random
import re
from collections import Counter

import numpy as np

from lakewright.llm import collocations
from lakewright.llm.collocations import Words, paths


def slow(rows, least, longest, most):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    own = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in own.items():
        if any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in own.items()):
            continue
        score, _, l, r = min((1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:most], 1))


def rows_of(seed):
    rnd = random.Random(seed)
    common = ["New York city", "the quick brown fox jumps over", "a a a a a a a a", "é 😀\x1cx", "zu\tder Zeit"]
    vocab = [f"w{i}" for i in range(12)] + ["É", "über"]
    rows = [(None, None), ("en", ""), ("en", " \t.\n"), ("de", "w1 " * 400), (None, "new york " * 9)]
    for _ in range(120):
        text = " ".join(rnd.choice(common) if rnd.random() < 0.3 else rnd.choice(vocab) for _ in range(rnd.randint(1, 60)))
        rows.append((rnd.choice(["en", "de", "und", None]), "".join(rnd.choice(".,;:!?\n\v\f\r ") if c == " " and rnd.random() < 0.1 else c for c in text)))
    return rows + rows[20:40]


def test_collocations(spark):
    for seed, least, longest, most in ((1, 5, 5, 2000), (2, 12, 5, 7), (3, 4, 3, None)):
        rows = rows_of(seed)
        df = spark.createDataFrame([(a, b, "clash", 1, 2) for a, b in rows], "lang string, text string, phrase string, n int, a int").repartition(3)
        got = sorted(tuple(r) for r in collocations.collocations(df, least, longest, most).collect())
        assert got == slow(rows, least, longest, most) and len(got) > 15
    assert collocations.collocations(df.where("false")).count() == 0
    assert collocations.collocations(df.where("text is null")).count() == 0


def test_large_counts(spark):
    """Products of over 64 bits."""
    found = spark.createDataFrame([("x", 9 * 10**12, 10**13, 9 * 10**12, 10**13)], "p string, a long, n long, l long, r long")
    assert found.selectExpr(f"{collocations.SCORE} as s").first().s == 1000


def test_paths_stand_for_all_edges():
    rnd = random.Random(5)
    for trial in range(60):
        text = b"\n".join(b" ".join(rnd.choice([b"a", b"b", b"c d e f g h i j", b"k"]) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 30)))
        w = Words("en", [text])
        links = w.more & (np.random.default_rng(trial).random(len(w.ids)) < 0.9)
        got, want = Counter(), Counter()
        phrases, n = paths(w, links, 4)
        for p, k in zip(phrases, n, strict=True):
            p = p.split()
            for i in range(max(1, len(p) - 3)):
                got[tuple(p[i : i + 4])] += k
        for i in range(len(w.ids)):
            m = 1
            while m < 4 and links[i + m - 1]:
                m += 1
            if m > 2:
                want[tuple(w.of[x] for x in w.ids[i : i + m])] += 1
        assert got == want
        assert len(phrases) <= len(want)


def test_chunks_end_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK", 50)
    text = ("one two three. " * 40 + "x" * 300 + " four").encode()
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", None], "text": [text.decode(), "vier", None]})
    got = Counter()
    for w in collocations.chunks([batch.set_column(0, "lang", pa.array(["en", "de", "und"]))]):
        got.update((w.lang, w.of[i]) for i in w.ids.tolist())
    assert got == Counter({("en", b"one"): 40, ("en", b"two"): 40, ("en", b"three"): 40, ("en", b"x" * 300): 1, ("en", b"four"): 1, ("de", b"vier"): 1})


def test_bitmap_holds_every_hash_and_few_others(spark):
    rng = np.random.default_rng(5)
    own, other = (rng.integers(0, 1 << 64, 20_000, dtype=np.uint64) for _ in range(2))
    df = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "h long")
    found = collocations.Bitmap(collocations.bitmap(df))
    assert found.has(own).all() and found.has(other).sum() <= 20
    assert not collocations.Bitmap(collocations.bitmap(df.where("false"))).has(own).any()


def test_flow_adds_up_level_by_level(spark):
    """Shorter phrases are sums of those one word longer; no edge is made into rows of all its beginnings."""
    edges = spark.createDataFrame([("en", "a b c d e", 3), ("en", "a b c d f", 2), ("en", "a b c d", 1), ("en", "a b c x y", 5), ("en", "a b c", 7), ("de", "a b c", 1)], "lang string, phrase string, n long")
    made = collocations.flow(edges, 5)
    got = {(r.lang, r.phrase): r.n for r in made.collect()}
    assert got == {("en", "a b c d e"): 3, ("en", "a b c d f"): 2, ("en", "a b c x y"): 5, ("en", "a b c d"): 6, ("en", "a b c x"): 5, ("en", "a b c"): 18, ("de", "a b c"): 1}
    assert "Generate" not in made._jdf.queryExecution().toString()
