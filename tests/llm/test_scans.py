"""Operators that look at each text alone, against brute force, round trips and the library."""

import hashlib
import random
import re
import zlib

import pytest

from lakewright.llm import decontamination, html_blocks, licenses, sentencepieces, transport_stream

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


ODD = [None, "", "   \n", "x", "Ünï — çode", "a" * 300_000, "word " * 60_000]


def test_decontamination(spark, make):
    rnd = random.Random(4)
    vocab = ["one", "two", "three", "vier", "fünf", "six"]
    items = {str(i): " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 9, 10, 14]))) for i in range(12)}
    texts = [", ".join(rnd.choice(vocab).upper() for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    texts += [f"Start. {items['3']} end", items["5"], items["5"], *ODD]
    bench = spark.createDataFrame([(int(k), v) for k, v in items.items()] + [(3, items["3"]), (None, "one two three"), (99, None)], "item_id long, text string")
    whole = by_id(decontamination.contamination(make(texts), bench))
    old, decontamination.BLOCK_BYTES = decontamination.BLOCK_BYTES, 200
    try:
        blocks = by_id(decontamination.contamination(make(texts), bench))
    finally:
        decontamination.BLOCK_BYTES = old
    for i, t in enumerate(texts):
        want = decontamination.brute(t, items)
        for got in (whole[i], blocks[i]):
            assert (got.n_words, got.n_hit, got["items"]) == want, t
        assert whole[i].n_words == len(WORD.findall(lower(t or "")))
        hit = [w for s in whole[i].spans for w in WORD.findall(lower(t[s.start : s.end]))]
        assert len(hit) == want[1]
    kept = decontamination.clean(make(texts), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i in whole if not whole[i].n_hit} and kept.columns == make(texts).columns
    assert decontamination.contamination(make(texts).where("false"), bench).count() == 0
    none = by_id(decontamination.digest(decontamination.contamination(make(texts), bench.where("false"))))
    assert all(not r.contaminated and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in none.values())


def test_large_benchmark_keeps_rows(spark, make, monkeypatch):
    """Rows that share a doc_id or have none stay one row each when the benchmark is many blocks."""
    items = {str(i): " ".join(f"w{i}x{k}" for k in range(12)) for i in range(20)}
    bench = spark.createDataFrame([(int(k), v) for k, v in items.items()], "item_id long, text string")
    docs = make([(1, f"a {items['3']} {items['8']} b"), (1, "other text"), (1, None), (2, f"a, {items['4']}"), (2, f"a, {items['4']}"), (None, items["5"]), (None, "clean"), (None, f"é {items['6']} é {items['7']}")])

    def found():
        return sorted(map(str, decontamination.contamination(docs, bench).collect()))

    whole = found()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    own = decontamination.blocks(bench, 10)
    assert own.count > 3 and own.lengths == [10] and len(whole) == 8
    assert [own.near()(t) for t in (b"other text", b"", f"A b {items['7']}".encode())] == [False, False, True]
    assert found() == whole
    left = [r.text for r in decontamination.clean(docs, bench).collect()]
    assert sorted(map(str, left)) == ["None", "clean", "other text"]


def test_large_benchmark_by_brute_force(spark, make, monkeypatch):
    """Blocks, short items and overlaps of items of several blocks against every place."""
    rnd = random.Random(8)
    words_ = [f"w{i}" for i in range(6)]
    items = {f"i{k}": " ".join(rnd.choices(words_, k=rnd.choice((0, 1, 3, 4, 5, 8)))) or None for k in range(40)}
    items["i1"] = items["i0"]
    texts = [" ".join(rnd.choices([*words_, "x", "y", "z"], k=rnd.randint(0, 60))) for _ in range(80)] + [None, "", "x y"]
    bench, docs = spark.createDataFrame(list(items.items()), "item_id string, text string"), make(texts)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert decontamination.blocks(bench, 4).count > 5
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench, 4).collect()}
    want = {i: decontamination.brute(t, items, 4) for i, t in enumerate(texts)}
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in got.items()} == want
    left = decontamination.clean(docs, bench, 4)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[1]}


def test_licenses(make):
    phrases = list(licenses.PHRASES)
    rnd = random.Random(5)
    vocab = sorted({w for p in phrases for w in p.split()}) + ["filler"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(80)) for _ in range(60)]
    texts += ["Under the MIT License; apache license, version 2.0. CC-BY-NC", "under the mit under the mit license license", licenses.TEMPLATES["gpl"].replace("you can", "you could").upper(), *ODD]
    got = by_id(licenses.scan_licenses(make(texts)))
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        found = [(a, p) for p in phrases for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        r, starts = got[i], [a for a, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({licenses.PHRASES[p] for _, p in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    gpl = got[62]
    assert gpl.labels == "gpl" and gpl.base_labels == "" and 0.9 < gpl.score < 1 and gpl.spans[0].first == 0


def test_license_chains_by_brute_force():
    """Matching statistics, chains and labels against every substring and every chain of matches."""
    rnd = random.Random(12)
    w = "abcdefgh"
    templates = {k: " ".join(rnd.choices(w, k=n)) for k, n in (("x", 14), ("y", 9), ("z", 18))}
    sc = licenses.Scanner({"a b": "p"}, templates)
    known = [["a", "b"], *(t.split() for t in templates.values())]
    pieces = {tuple(t[i:j]) for t in known for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    some = 0
    for _ in range(200):
        own = list(templates.values())
        text = " ".join(x for _ in range(4) for x in rnd.choice([rnd.choice(own).split()[rnd.randint(0, 8) :][: rnd.randint(2, 9)], rnd.choices(w + "q", k=3)]))
        ids = text.split()
        longest = [max((n for n in range(1, i + 2) if tuple(ids[i + 1 - n : i + 1]) in pieces), default=0) for i in range(len(ids))]
        if "q" not in ids:
            assert [n for *_, n in sc.statistics([sc.vocab.get(x, -1) for x in ids], 0)] == longest
        ends = [i for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(ids) or longest[i + 1] <= n)]
        want = {}
        for t, words in enumerate(known[1:], 1):
            matches = []
            for i in ends:
                n = longest[i]
                places = [p for p in range(n - 1, len(words)) if words[p - n + 1 : p + 1] == ids[i - n + 1 : i + 1]]
                if places:
                    matches.append((i - n + 1, i, places[0] - n + 1, places[0]))

            def best(k, matches=matches, size=len(words)):
                a, b, ta, _ = matches[k]
                return b - a + 1 + max([0, *(best(j) for j, (_, e, _, te) in enumerate(matches) if e < a and te < ta and a - e <= 2 * size)])

            top = max([0, *map(best, range(len(matches)))])
            if top and top >= 0.5 * len(words):
                want[t] = top / len(words)
        got = {t: share for t, (share, *_) in sc.scan(text.encode(), 3, 0.5)[2].items()}
        assert got == want, text
        some += len(want)
    assert some > 50


def test_transport_stream(make):
    texts = [*ODD, "a" * 576, "b" * 577, "x" * (576 * 60), "same", "same"]
    got = by_id(transport_stream.media(make(texts), keep_stream=True))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(r.stream) == 188 * (len(r.stream) // 188) and r.media_sha256 == hashlib.sha256(bytes(r.stream)).hexdigest()
        assert len(r.pts) == len(payload) // 576 and r.random_access == list(range(0, len(r.pts), 25)) and "errors=0" in r.feature
    assert got[len(texts) - 1].media_sha256 == got[len(texts) - 2].media_sha256


def slow_reader(stream):
    """(payload, times, random-access units, clock) of a stream, packet by packet."""
    payload, pts, points, clock, unit, pid_of = b"", [], [], [], -1, {}
    for at in range(0, len(stream), 188):
        x = stream[at : at + 188]
        assert x[0] == 0x47
        pid, start, at_ = (x[1] & 31) << 8 | x[2], x[1] & 0x40, 4
        if pid == 0:
            pid_of["pmt"] = (x[15] & 31) << 8 | x[16]
        elif pid == pid_of["pmt"]:
            pid_of["es"] = (x[18] & 31) << 8 | x[19]
        elif pid == pid_of["es"]:
            flags = 0
            if x[3] & 0x20:
                at_, flags = 5 + x[4], x[5] if x[4] else 0
            if flags & 0x10:
                n = int.from_bytes(x[6:12], "big")
                clock.append((n >> 15) * 300 + (n & 511))
            body = x[at_:]
            if start:
                unit += 1
                assert body[:3] == b"\0\0\1"
                t = body[9:14]
                pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
                body = body[9 + body[8] :]
                if flags & 0x40:
                    points.append(unit)
            payload += body
    return payload, pts, points, clock


def test_streams_by_another_reader():
    for n in (1, 26, 77):
        text = random.Random(n).randbytes(n * 576)
        stored = transport_stream.mux(text)
        payload, pts, points, clock = slow_reader(stored)
        s = transport_stream.demux(stored)
        assert payload == text == s.payload and pts == s.pts.tolist() == [90_000 + 3_600 * i for i in range(n)]
        assert points == [i for i, x in enumerate(s.random_access) if x] and clock == s.clock.tolist() and s.errors == s.twice == 0
        double = stored[: 188 * 4] + stored[188 * 3 : 188 * 4] + stored[188 * 4 :]
        d = transport_stream.demux(double)
        assert (d.payload, d.errors, d.twice) == (text, 0, 1)


def test_several_articles():
    story = "<p>" + "some long text " * 12 + "</p>"
    page = f"<body><nav>x</nav><article><h2>One</h2>{story}</article><article><h2>Two</h2>{story}</article><article><p>teaser</p></article></body>"
    one = ("some long text " * 12).strip()
    assert html_blocks.extract(page) == f"One\n{one}\nTwo\n{one}"


def test_short_articles_and_names_of_subjects_stay():
    story = "<p>" + "some long text " * 12 + "</p>"
    one = ("some long text " * 12).strip()
    page = f"<body><article>{story}</article><article><p>Rain fell on the town all night, and nobody slept well.</p></article><article><h3>Two</h3><p>lines</p></article><article><a href=x>Read</a><p><a href=y>more.</a></p></article></body>"
    assert html_blocks.extract(page) == f"{one}\nRain fell on the town all night, and nobody slept well.\nTwo\nlines"
    for kept in ("comments-on-law", "share-prices", "adLaws intro", "x2"):
        assert html_blocks.extract(f"<article>{story}<div class='{kept}'><p>said</p></div></article>") == f"{one}\nsaid"
    for gone in ("comments", "comment-list", "ad-slot-2", "post-comments wide", "shareButtons", "story ad", "newsletter-signup"):
        assert html_blocks.extract(f"<article>{story}<div class='{gone}'><p>said</p></div></article>") == one


def test_damaged_streams():
    s = bytearray(transport_stream.mux(b"q" * 5760))
    lost = bytes(s[: 188 * 6] + s[188 * 10 :])  # one unit's packets
    assert transport_stream.demux(lost).errors == 0 or transport_stream.demux(lost).payload != b"q" * 5760
    gap = bytes(s[: 188 * 3] + s[188 * 4 :])
    assert transport_stream.demux(gap).errors == 1
    s[10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        transport_stream.demux(bytes(s))
    with pytest.raises(ValueError, match="sync"):
        transport_stream.demux(b"\0" * 188)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p><b>First  para<br>two&nbsp;three<p>Of.</p><form><p>mail</p></form><div class="comments"><p>reader</p></div><p>Last &lt;one&gt;</p></article><footer>&copy; f</footer></body></html>"""


def test_html(spark):
    loose = "<div id=top><a href=a>Menu</a> <a href=b>More</a></div><br><div class=story><p>" + "long text " * 30 + "</p><p>short.</p><p>" + "end text " * 20 + "</p></div><div class='footer'>legal</div>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain"), (5, "u", loose), (5, "u", loose), (6, "u", "<p>" + "x " * 200_000), (7, "u", "<main><p>a</p>b</main>c<!-- <p>d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = {r.page_id: r for r in html_blocks.main_text(df).collect()}
    assert got[1].text == "Head & tail\nFirst para two three\nOf.\nLast <one>"
    assert (got[2].text, got[3].text, got[4].text, got[7].text) == ("", "", "plain", "a\nb")
    assert got[5].text.split("\n")[1] == "short." and "Menu" not in got[5].text and "legal" not in got[5].text
    assert got[6].n_chars == 399_999 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_blocks.main_text(df).count() == 8 and html_blocks.main_text(df.where("false")).count() == 0


def test_html_wrapped_paragraphs():
    """Wrappers of single paragraphs, short paragraphs and adverts between cut nothing off a page that names no article."""
    texts = ["A heading", "first " * 120, "Short one.", "second " * 20, "third " * 30, "The end."]
    ad = "<div class=ad>" + "<p>buy this</p>" * 5 + "</div>"
    wrapped = [f"<div><div><p>{t}</p></div></div>" for t in texts]
    want = "\n".join(t.strip() for t in texts)
    foot = "<div class=footer><p>a</p><p>b</p><p>c</p></div><div><p>legal</p></div>"
    for page in ("".join(wrapped), "<body>" + "".join(wrapped) + "</body>", f"<body><div id=x>{''.join(wrapped[:2])}{ad}{''.join(wrapped[2:5])}{ad}{wrapped[5]}</div>{foot}</body>"):
        assert html_blocks.extract(page) == want
    direct = f"<body><p>{texts[1]}</p>{ad}<p>Short one.</p>{ad}<p>{texts[3]}</p></body>"
    assert html_blocks.extract(direct) == "\n".join(t.strip() for t in texts[1:4])


def test_sentencepieces(make):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(6)
    alphabet = "aeinorst ,.\n\t▁é日😀-'\"#0"
    texts = [None, "", " ", "\n", "  a  b ", "<s></s><0x41>", "Hello, world! It's 3.14\r\n", "a\x00b", "x" * 5000, *["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(150)]]
    got = by_id(sentencepieces.encode(make(texts), path, keep_ids=True))
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        assert got[i].ids == ids and got[i].decoded == sp.decode(ids), t
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    v = sentencepieces.Vocabulary(path)
    for t in filter(None, texts):
        marked = "▁" + t.replace(" ", "▁")
        if len(marked) < 300:
            assert "".join(v._short(marked)) == marked and v._short(marked) == v._long(marked)
    m = sentencepieces.Memo(v)
    m.LIMIT = 5
    for t in ["one two three four five six seven", "one two eight", "one nine ten eleven"] * 3:
        assert sentencepieces.encode_text(m, t) == " ".join(map(str, sp.encode(t, add_eos=True)))
        m.settle()
