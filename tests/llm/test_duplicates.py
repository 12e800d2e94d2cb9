"""Near-duplicate operators and components, against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from lakewright.llm import paragraphs, repeated_bytes, simhash
from lakewright.llm.common import words
from lakewright.llm.components import components, forest


def classes(pairs, nodes):
    low = dict(forest([a for a, _ in pairs], [b for _, b in pairs]))
    return {n: low.get(n, n) for n in nodes}


def test_components(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000), (-5, 2001)]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == classes(pairs, nodes)
    assert components(df.where("false")).count() == 0


def slow_fingerprint(t, size=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for s in "\t\n\x0b\x0c\r":
        w = w.replace(s, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(make):
    rnd = random.Random(8)
    vocab = [f"w{i}é" for i in range(50)]
    base = [" ".join(rnd.choice(vocab) for _ in range(300)) for _ in range(12)]
    texts = [None, "", " \n", "one", "One  TWO", "x y z q", "word " * 150_000, *base, *base[:3]]
    for b in base:
        w = b.split()
        for _ in range(6):
            w[rnd.randrange(300)] = rnd.choice(vocab)
            texts.append(" ".join(w))
    ids = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(make([*ids, ids[8]])).collect()}
    fp = {i: slow_fingerprint(t) for i, t in ids}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = classes(near, fp)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    docs = make(ids)
    kept = simhash.one_of_each(docs, 3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.one_of_each(docs.where("false")).count() == 0
    # Rows that share an id, or have none.
    odd = make([(1, base[0]), (1, base[1]), (1, base[1]), (2, base[0]), (None, base[1]), (None, base[2]), (None, base[2])])
    left = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(odd).collect()), key=str)
    assert left == sorted([(1, base[0]), (1, base[1]), (None, base[2])], key=str)


def test_anchor_links_are_complete():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(3))]))
    fp = np.unique(np.concatenate([fp, base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))  # one dense ball
    anchor, index = simhash.anchors(fp)
    order = np.lexsort((fp[index], anchor))
    a, b = simhash.compare(anchor[order], fp[index][order])
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2, 1))
    nodes = fp.tolist()
    assert classes(list(zip(a.tolist(), b.tolist(), strict=True)), nodes) == classes(list(zip(fp[i].tolist(), fp[j].tolist(), strict=True)), nodes)


def word_lines(text, least_words):
    """(first word, words) of the long lines, and all words."""
    w, lines = [], []
    for line in text.encode().split(b"\n"):
        own = words(line)
        if len(own) >= least_words:
            lines.append((len(w), own))
        w += own
    return lines, w


def pieces_of(w):
    """(first word, words) of the pieces, by comparing every pair with its neighbours."""
    def value(i):
        if not 0 <= i < len(w) - 1:
            return 2**64
        x, y = (np.array([xxhash.xxh3_64_intdigest(v)], np.uint64) for v in w[i : i + 2])
        return int(paragraphs.mixed(x * paragraphs.SALTS[0] + y)[0])

    values = {i: value(i) for i in range(-8, len(w) + 8)}
    starts = [i for i in range(len(w)) if i == 0 or all(values[i] < values[i - k] and values[i] <= values[i + k] for k in range(1, 9)) and values[i] < 2**64]
    return [(a, w[a:b]) for a, b in zip(starts, [*starts[1:], len(w)], strict=False) if b - a >= 5]


def jaccard_components(docs, least_words, least):
    """Component of each paragraph (doc_id, is a line, first word), and its number of words."""
    own, size = {}, {}
    for i, t in docs:
        lines, w = word_lines(t or "", least_words)
        for kind, units in ((True, lines), (False, pieces_of(w) if len(w) < 50_000 else [])):
            for first, u in units:
                own[(i, kind, first)] = (kind, frozenset(tuple(u[k : k + 5]) for k in range(len(u) - 4)), tuple(u))
                size[(i, kind, first)] = len(u)
    by_set = {}
    for k, x in own.items():
        by_set.setdefault(x, []).append(k)
    links = [(v[0], k) for v in by_set.values() for k in v[1:]]
    kinds = list(by_set)
    links += [
        (by_set[x][0], by_set[y][0]) for n, x in enumerate(kinds) for y in kinds[:n]
        if x[0] and y[0] and len(x[1] & y[1]) >= least * len(x[1] | y[1]) - 1e-9
    ]
    low = classes(links, list(own))
    stays = {}
    for k, c in low.items():  # the first by doc_id and place stays, of either kind
        stays[c] = min(stays.get(c, k), k)
    return {k: stays[c] for k, c in low.items()}, size


def chains(units, least_words):
    """Passages of adjoining pieces (first, size)."""
    out, run = [], []
    for a, n in sorted(units):
        if run and run[-1][0] + run[-1][1] != a:
            out.append(run)
            run = []
        run = [*run, (a, n)]
    return [(r[0][0], r[-1][0] + r[-1][1]) for r in [*out, run] if sum(n for _, n in r) >= least_words]


def left_of(text, lines, spans):
    """The text without lines that begin with these words and without the words of the spans."""
    out, n = [], 0
    for line in text.split("\n"):
        w = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line)]
        gone = [n in lines or any(a <= n + i < b for a, b in spans) for i in range(len(w))]
        n += len(w)
        if not w or not all(gone):
            ends = [x[0] for x in w[1:]] + [len(line)]
            out.append(line[: w[0][0] if w else None] + "".join(line[w[i][0] : ends[i]] for i in range(len(w)) if not gone[i]))
    return "\n".join(out)


def expected(docs, want, size):
    """By document: lines, linked, removed, those that keep them, passages, words in them, removed spans."""
    many = {}
    for k, c in want.items():
        many[c] = many.get(c, 0) + 1
    out = {}
    for i, _ in docs:
        lines = [k for k in want if k[0] == i and k[1]]
        pieces = [k for k in want if k[0] == i and not k[1]]
        linked = chains([(k[2], size[k]) for k in pieces if many[want[k]] > 1], 20)
        gone = chains([(k[2], size[k]) for k in pieces if want[k] != k], 20)
        out[i] = (len(lines), sum(many[want[k]] > 1 for k in lines), sum(want[k] != k for k in lines), sorted({want[k][0] for k in lines if want[k] != k}), len(linked), sum(b - a for a, b in linked)), {k[2] for k in lines if want[k] != k}, gone
    return out


def test_paragraphs(make):
    rnd = random.Random(9)
    vocab = [f"word{i}" for i in range(400)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(40, 90))] for _ in range(8)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            w = list(rnd.choice(passages)) if rnd.random() < 0.4 else [rnd.choice(vocab) for _ in range(rnd.randint(3, 60))]
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "changed"
            if rnd.random() < 0.3:  # a passage within a longer line
                w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 90))] + w + [rnd.choice(vocab) for _ in range(rnd.randint(5, 90))]
            lines.append(", ".join(w))
        docs.append((i, "\n".join(lines)))
    docs += [(60, None), (61, ""), (62, "short line\n\n"), (63, " ".join(["same"] * 100_000)), (64, docs[3][1]), (65, " ".join(["same"] * 100_000))]
    want, size = jaccard_components(docs, 20, 0.8)
    got = {r.doc_id: r for r in paragraphs.paragraph_duplicates(make(docs)).collect()}
    left = {r.doc_id: r for r in paragraphs.without_repeats(make(docs)).collect()}
    found = expected(docs, want, size)
    assert sum(f[0][4] for f in found.values()) > 20
    for i, t in docs:
        r, (own, lines, spans) = got[i], found[i]
        if i in (63, 65):  # one piece of 100,000 words
            assert (r.n_paragraphs, r.n_linked, r.n_passages, r.passage_words) == (1, 1, 1, 100_000)
            assert i in left if i == 63 else i not in left
            continue
        assert (r.n_paragraphs, r.n_linked, r.n_removed, r.kept_in, r.n_passages, r.passage_words) == own, i
        assert r.passage_words_removed == sum(b - a for a, b in spans)
        text = left_of(t or "", lines, spans)
        if (lines or spans) and not text.strip():
            assert i not in left
        else:
            assert (left[i].text or "") == text and (left[i].n_chars in (len(text), None))
    assert paragraphs.without_repeats(make(docs)).columns == make(docs).columns
    assert paragraphs.paragraph_duplicates(make(docs).where("false")).count() == 0
    twice = paragraphs.paragraph_duplicates(make([docs[0], docs[0], (None, docs[0][1])])).collect()
    assert {r.doc_id for r in twice} == {0, None}


def test_recall_of_passages(make):
    """Passages of over 50 words at any place of longer lines, and clean documents."""
    rnd = random.Random(19)
    vocab = [f"w{i}" for i in range(3_000)]

    def noise(n):
        return [rnd.choice(vocab) for _ in range(n)]

    shared = [noise(rnd.randint(51, 80)) for _ in range(60)]
    frequent = noise(12)
    docs = []
    for i in range(600):
        w = noise(rnd.randint(20, 200)) + (shared[i % 60] if i < 240 else frequent if i % 2 else []) + noise(rnd.randint(20, 200))
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r.n_passages for r in paragraphs.paragraph_duplicates(make(docs)).collect()}
    assert np.mean([got[i] > 0 for i in range(240)]) >= 0.9 and not any(got[i] for i in range(240, 600))


def test_large_buckets(make, monkeypatch):
    """Near copies of one line in larger buckets than are checked by pairs."""
    rnd = random.Random(20)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.choice([1, 1, 2, 2, 3, 12])):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    want, _ = jaccard_components(docs, 20, 0.8)
    want = {k[0]: c[0] for k, c in want.items() if k[1]}
    for few in (4, 1_000):
        monkeypatch.setattr(paragraphs, "FEW", few)
        got = {r.doc_id: (r.n_linked, r.n_removed) for r in paragraphs.paragraph_duplicates(make(docs)).collect()}
        near = [i for i in got if got[i] == (1 if sum(c == want[i] for c in want.values()) > 1 else 0, int(want[i] != i))]
        assert len(near) >= 297  # banding misses some of those of 12 changes


def test_unlike_classes_of_large_buckets(make, monkeypatch):
    """Lines that share half their words, so that most of a large bucket is unlike its leaders, each with a near copy."""
    rnd = random.Random(21)
    shared, docs = [f"w{i}" for i in range(70)], []
    for i in range(150):
        own = shared + [f"y{rnd.randrange(10**6)}" for _ in range(40)]
        docs.append((2 * i, " ".join(own)))
        own[rnd.randrange(72, 110)] = "z"
        docs.append((2 * i + 1, " ".join(own)))
    monkeypatch.setattr(paragraphs, "FEW", 4)
    got = {r.doc_id: (r.n_linked, r.n_removed) for r in paragraphs.paragraph_duplicates(make(docs)).collect()}
    assert got == {i: (1, i % 2) for i in range(300)}


def test_repeated_bytes(make):
    rnd = random.Random(10)
    for length, k, alphabet in ((20, 8, "ab"), (30, 6, "abcdefgh"), (24, 8, "aé日")):
        parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(10, 80))) for _ in range(5)]
        texts = ["".join(rnd.choice(parts) if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(0, 5))) for _ in range(25)]
        texts += [None, "", "x" * 500, texts[2], "ab" * 40, "short"]
        want = repeated_bytes.brute([(t or "").encode() for t in texts], length)
        least = length - 5
        shorter = repeated_bytes.brute([(t or "").encode() for t in texts], least)
        got = {r.doc_id: r for r in repeated_bytes.remove_repeats(make(texts), length, k, keep_text=True, least=least).collect()}
        for i, t in enumerate(texts):
            raw, r = (t or "").encode(), got[i]
            assert bytes(r.kept) == want[i] and r.kept_sha256 == hashlib.sha256(want[i]).hexdigest()
            assert (r.n_bytes, r.n_removed, r.n_spans, r.n_repeated) == (len(raw), len(raw) - len(want[i]), len(r.spans), len(raw) - len(shorter[i]))
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert repeated_bytes.remove_repeats(make(texts).where("false")).count() == 0


def test_repeated_bytes_of_long_texts(make, monkeypatch):
    rnd = random.Random(11)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    texts = [long, "q" + long[30_000:31_000] + "z" * 2_000, long[:500]]
    monkeypatch.setattr(repeated_bytes, "BUFFER", 4_000)
    got = {r.doc_id: r for r in repeated_bytes.remove_repeats(make(texts)).collect()}
    want = repeated_bytes.brute([t.encode() for t in texts], 400)
    assert [got[i].kept_sha256 for i in range(3)] == [hashlib.sha256(x).hexdigest() for x in want]


def test_repeated_bytes_of_frequent_lines(make, monkeypatch):
    """Anchors of more contexts than a task takes, of equal texts and of texts that share a line only."""
    rnd = random.Random(12)

    def noise(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))

    line, passage, other = noise(90), noise(420), noise(300)
    texts = [noise(rnd.randint(0, 300)) + line + noise(rnd.randint(200, 500)) for _ in range(120)]
    texts += [noise(200) + passage + noise(60) for _ in range(20)] + [noise(50) + other + noise(80) for _ in range(12)] + [texts[5]] * 40 + [texts[7] + "x", "y" + texts[9]]
    rnd.shuffle(texts)
    texts += [noise(300) + line + noise(300) for _ in range(40)]
    want, shorter = (repeated_bytes.brute([t.encode() for t in texts], n) for n in (400, 256))
    for many, sample in ((16, 1_000), (20_000, 3), (16, 3)):
        monkeypatch.setattr(repeated_bytes, "MANY", many)
        monkeypatch.setattr(repeated_bytes, "SAMPLE", sample)
        got = {r.doc_id: r for r in repeated_bytes.remove_repeats(make(texts)).collect()}
        for i, t in enumerate(texts):  # the last texts share nothing: no string of a batch may be known
            assert (got[i].n_removed, got[i].kept_sha256) == (len(t) - len(want[i]), hashlib.sha256(want[i]).hexdigest())
            assert got[i].n_repeated == len(t) - len(shorter[i])


def test_paragraphs_of_rows_without_id(make):
    """A paragraph that also, or only, stands in a row without a doc_id is linked to its near copies."""
    p, q = ([f"{c}{i}" for i in range(60)] for c in "pq")
    texts = [(None, " ".join(p)), (1, " ".join(p)), (2, " ".join(p[:-1] + ["new"])), (None, " ".join(q)), (3, " ".join(["new"] + q[1:])), (4, "alone " * 30)]
    got = {r.doc_id: r for r in paragraphs.paragraph_duplicates(make(texts)).collect()}
    assert {i: r.n_linked for i, r in got.items()} == {None: 2, 1: 1, 2: 1, 3: 1, 4: 0}
    assert {i: r.n_removed for i, r in got.items()} == {None: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_template_with_own_fields(make, monkeypatch):
    """Lines of a template of which any two are unlike: buckets are dealt out anew until none is large, and few
    classes are dealt more than once; near copies among them are found."""
    monkeypatch.setattr(paragraphs, "MANY", 40)
    rnd = random.Random(23)

    def line():
        w = [f"t{k}" for k in range(200)]
        for k in rnd.sample(range(200), 6):
            w[k] = f"f{rnd.randrange(10**9)}"
        return w

    docs = [(i, " ".join(line())) for i in range(300)]
    for i in range(0, 40, 2):
        w = docs[i][1].split()
        w[rnd.randrange(200)] = "changed"
        docs.append((1000 + i, " ".join(w)))
    dealt = []
    again = paragraphs.dealt_again
    monkeypatch.setattr(paragraphs, "dealt_again", lambda names, sets, rows: dealt.append((rows, names.count())) or again(names, sets, rows))
    got = {r.doc_id: r.n_linked for r in paragraphs.paragraph_duplicates(make(docs)).collect()}
    linked = {i for i, n in got.items() if n}
    assert linked <= {i for i in range(0, 40, 2)} | {1000 + i for i in range(0, 40, 2)} and len(linked) >= 38
    assert [r for r, _ in dealt] == list(range(10, 10 + 5 * len(dealt), 5)) and 1 <= len(dealt) <= 3 and dealt[0][1] <= 320


def test_sketches_of_a_bucket():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 16, 17, 60, 1, 9]
    bucket = np.repeat(np.arange(len(sizes)) * 7 - 9, sizes)
    k = rng.integers(-(2**63), 2**63, (len(bucket), 4), dtype=np.int64)
    for x in range(1, len(k), 2):  # near the one before, by up to 80 bits
        flips = np.packbits(rng.permutation(256) < rng.integers(0, 80)).view(np.int64)
        k[x] = k[x - 1] ^ flips
    name = rng.permutation(len(bucket))
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(name), pa.array(k.tolist(), pa.list_(pa.int64()))], ["bucket", "name", "k"])
    want = {
        (min(name[x], name[y]), max(name[x], name[y])) for x in range(len(k)) for y in range(x)
        if bucket[x] == bucket[y] and np.bitwise_count(k[x] ^ k[y]).sum() <= 256 - paragraphs.AGREE
    }
    assert len(want) > 10
    for size in (1, 5, 200):
        made = [r for b in paragraphs.near(iter([whole.slice(at, size) for at in range(0, len(k), size)])) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in made} == want and len(made) == len(want)


def test_no_link_is_lost(make, monkeypatch):
    """Many pairs of lines that just reach 0.8, of which bands miss some, half of them with a frequent phrase."""
    rnd = random.Random(31)
    phrase, docs = [f"p{k}" for k in range(12)], []
    for i in range(1500):  # 90 shingles, of which the other line has 80
        w = [f"c{i}x{k}" for k in range(82)] + (phrase if i % 2 else [f"d{i}x{k}" for k in range(12)])
        docs.append((2 * i, " ".join(w)))
        w[rnd.randrange(10, 20)] = w[rnd.randrange(60, 70)] = "new"
        docs.append((2 * i + 1, " ".join(w)))
    want = {i: (1, i % 2) for i, _ in docs}
    for few in (16, 1):  # of one, all shared shingles are frequent
        monkeypatch.setattr(paragraphs, "FEW", few)
        monkeypatch.setattr(paragraphs, "BLOCK", 100, raising=False)
        got = {r.doc_id: (r.n_linked, r.n_removed) for r in paragraphs.paragraph_duplicates(make(docs)).collect()}
        assert {i: (got[i], want[i]) for i in got if got[i] != want[i]} == {}


def test_prefixes_meet():
    """Any two lines of similarity 0.8 share a shingle of their prefixes."""
    rnd = random.Random(32)
    lines = []
    for _ in range(150):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(20, 90))]
        lines += [w, [*w[: len(w) - rnd.randint(0, 8)]], [*w[:-1], "new"], ["a"] * rnd.randint(20, 30)]
    u = paragraphs.Units([" ".join(w).encode() for w in lines], 20)
    n, prefix = u.prefixes(0.8)
    prefix = [set(x) for x in prefix.to_pylist()]
    own = [frozenset(tuple(" ".join(w).split()[k : k + 5]) for k in range(len(w) - 4)) for w in lines if len(w) >= 20]
    assert n.tolist() == [len(x) for x in own] and all(len(p) <= len(x) // 5 + 1 for p, x in zip(prefix, own, strict=True))
    near = [(x, y) for y in range(len(own)) for x in range(y) if 5 * len(own[x] & own[y]) >= 4 * len(own[x] | own[y])]
    assert len(near) > 150 and all(prefix[x] & prefix[y] for x, y in near)


def test_rows_of_a_group_are_linear():
    """A bucket of n classes makes n - 1 pairs, and n similar classes that meet make n - 1 links: no pair of all."""
    import pyarrow as pa

    n = 16
    rows = [(5, k, -1) for k in range(n)] + [(9, k, (40 << 32) + 3) for k in range(n)] + [(11, 1, (40 << 32) + 3)]
    banded = pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["band", "name", "kind"])
    for size in (3, 100):
        made = {(r["bucket"], r["a"], r["b"], r["shingles"]) for b in paragraphs.candidates(iter(banded.to_batches(size))) for r in b.to_pylist()}
        assert {r for r in made if r[0] is None} == {(None, 0, k, None) for k in range(1, n)}
        assert {r for r in made if r[0] is not None} == {(9, k, None, 40) for k in range(n)}

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    own = [np.unique(np.append(base[: 90 - k % 5], rng.integers(0, 1 << 63, k % 5, dtype=np.uint64))) for k in range(30)]
    own += [rng.integers(0, 1 << 63, 90, dtype=np.uint64) for _ in range(10)]
    name = list(range(40))
    bits = pa.array([paragraphs.parity(x) for x in own], pa.list_(pa.int64()))
    t = pa.table({"bucket": [7] * 40, "name": name, "component": name, "shingles": pa.array([len(x) for x in own], pa.int32()), "place": pa.array([0] * 40, pa.int32()), "bits": bits, "own": [np.sort(x).tobytes() for x in own]})
    for size in (6, 100):
        may = [r["name"] for b in paragraphs.partners(0.8)(iter(t.to_batches(size))) for r in b.to_pylist()]
        assert may == name[:30]
        links = [(r["a"], r["b"]) for b in paragraphs.joined(0.8)(iter(t.to_batches(size))) for r in b.to_pylist()]
        assert len(links) == 29 and set(classes(links, name).values()) == {0, *range(30, 40)}
