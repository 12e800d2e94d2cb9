"""Fill-in-the-middle examples and their frames, against a slow version."""

import hashlib
import random
import re

import pytest

from lakewright.llm import fill_in_middle as fim


def slow(doc_id, text, rate=90, spm=20):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    g = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(u), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("frame_bytes", [1, 7, 16_384])
def test_examples(make, frame_bytes):
    rnd = random.Random(frame_bytes)
    texts = [None, "", "a", "é", "😀", "abc", "<P>", "x<M>y", "<P", "a" * 3000, "é" * 1000, " \n\r\n\x00", "<S", "M>", "Ünïcode ßtring", "word " * 40_000]
    texts += ["".join(rnd.choice("abZ é😀<PSM>\n.") for _ in range(rnd.randint(1, 120))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (None, None), (5, "abc"), (-3, "minus")]
    docs = make(rows)
    want = sorted((slow(*r) for r in rows), key=str)
    kept = fim.store(docs, frame_bytes)
    got = [tuple(r) for r in fim.examples(kept).collect()]
    assert sorted(got, key=str) == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r)[:7] for r in fim.digests(kept).collect()), key=str)
    assert digests == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in ((slow(*r), r) for r in rows)), key=str)


def test_frames():
    text = ("héllo wörld " * 5000 + "q" * 9000 + "!").encode()
    own, units, chars = fim.frames(text, 1000)
    assert units == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())) and chars == len(text.decode())
    stored = fim.Stored(units, chars, [{"units": u, "chars": c, "data": d} for u, c, d in own])
    assert b"".join(stored.raw(k) for k in range(len(own))) == text
    assert 50 < len(own) and max(len(stored.raw(k)) for k in range(len(own))) < 11_000  # one unit has 9,000 bytes
    # A cut needs one frame.
    seen = []
    raw = stored.raw
    stored.raw = lambda k: seen.append(k) or raw(k)
    k, at, before = stored.place(20_000)
    assert seen in ([k], []) and before + len(b"".join(fim.Stored.between(stored, (k, at, before), stored.place(units))).decode()) == chars


def test_markers_across_pieces():
    whole = b"<P>ab<S><c<<S<M>d<"
    for size in (1, 2, 3, 5, 100):
        stream = [whole[k : k + size] for k in range(0, len(whole), size)]
        assert b"".join(fim.restored(stream, "psm")) == b"abd<<c<<S"


def test_empty(make):
    none = make(["x"]).where("false")
    assert fim.digests(fim.store(none)).count() == 0 and fim.examples(fim.store(none)).count() == 0
