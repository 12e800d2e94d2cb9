"""Corner cases of the comparison, census, reshaping, sizing and journal operators."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewright.functions.text import _aligned, _edits, _lcs, _lcs_bits, _lcs_piles, table_cells
from lakewright.operators import catalog, census, compare, jobs, reports, reshape, sizing
from lakewright.sources.files import binary_files


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_normalise(spark):
    df = spark.createDataFrame([(1, "ﬁne  co-\noperate so­ft"), (2, None), (3, "a‍b‌c"), (4, "")], "id int, t string")
    got = dict(compare.normalise_corpus(df, "id", "t").select("id", "t").collect())
    assert got == {1: "fine cooperate soft", 2: None, 3: "a‍b‌c", 4: ""}


def test_multiset_diff_restores(spark):
    rnd = random.Random(1)
    a = [(i, rnd.choice("xyz")) for i in range(3) for _ in range(rnd.randint(0, 9))]
    b = [(i, rnd.choice("xyz")) for i in range(4) for _ in range(rnd.randint(0, 9))]
    mk = lambda x: spark.createDataFrame(x, "id int, token string")
    from collections import Counter

    d = {(r.id, r.token): (r.missing, r.extra) for r in compare.multiset_diff(mk(a), mk(b), "id", "token").collect()}
    ca, cb = Counter(a), Counter(b)
    assert all(ca[k] - d.get(k, (0, 0))[0] + d.get(k, (0, 0))[1] == cb[k] for k in {*ca, *cb})


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similarity_and_order(spark):
    rnd = random.Random(2)
    pairs = [(i, [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))], [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))]) for i in range(40)]
    df = spark.createDataFrame(pairs, "id int, a array<string>, b array<string>")
    got = {r.id: r for r in compare.order_score(compare.token_similarity(df, "a", "b"), "a", "b").collect()}
    for i, a, b in pairs:
        assert got[i].distance == edit(a, b)
        assert got[i].similarity == pytest.approx(1 - edit(a, b) / max(len(a), len(b)) if a != b else 1.0)


def test_similarity_of_long_texts(spark):
    """Beyond the room for codes, and beyond the built-in's cells, the distance is exact too."""
    rnd = random.Random(3)
    far = [f"w{i}" for i in range(25_000)]
    changed = [x if i % 1000 else f"new{i}" for i, x in enumerate(far)]
    a, b = ([rnd.choice("abcdef") for _ in range(n)] for n in (260, 310))
    df = spark.createDataFrame([(0, far, changed), (1, a, b), (2, far, far), (3, far, []), (4, [], a)], "id int, a array<string>, b array<string>")
    got = {r.id: (r.distance, r.similarity) for r in compare.token_similarity(df, "a", "b").collect()}
    assert got == {0: (25, 1 - 25 / 25_000), 1: (edit(a, b), pytest.approx(1 - edit(a, b) / 310)), 2: (0, 1.0), 3: (25_000, 0.0), 4: (260, 0.0)}
    tiny = {r.id: r.distance for r in compare.token_similarity(df.where("id in (1, 4)"), "a", "b", most=1).collect()}
    assert tiny == {1: edit(a, b), 4: 260}


def test_whole_similarity_sees_every_word(spark, data):
    from lakewright.plans import verify

    t = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 3000").collect()}
    got = {r.doc_id: r.distance for r in verify.v4_whole_similarity(spark, data).collect()}
    pairs = [i for i in sorted(t) if i + 1 in t and max(len(t[i]), len(t[i + 1])) > 40][:15]
    assert pairs and all(got[i] == edit(t[i], t[i + 1]) for i in pairs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert _lcs(a, b) == t[-1][-1]


def test_labels(spark):
    c = spark.createDataFrame([(1, "x", True), (2, "x", False), (3, "x", False), (3, "y", True)], "job int, check string, ok boolean")
    e = spark.createDataFrame([(2, "x")], "job int, check string")
    got = dict(compare.label_jobs(compare.classify_checks(c, e, ["job"]), ["job"]).collect())
    assert got == {1: "Perfect", 2: "Converted with expected changes", 3: "Needs review"}


def test_sniff_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"\x89PNG\r\n\x1a\n..")
    (tmp_path / "c.pdf").write_bytes(b"?")
    f = binary_files(spark, str(tmp_path)).withColumn("claimed", F.lit("pdf"))
    assert sorted((r.type or "", r.mismatch) for r in census.sniff(f, "content", "claimed").collect()) == [("", True), ("pdf", False), ("png", True)]


def test_scripts(spark):
    df = spark.createDataFrame([(1, "שלום abc"), (2, "नमस्ते"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: (r.script, r.right_to_left) for r in census.dominant_script(census.script_census(df, "id", "t"), "id").collect()}
    assert got == {1: ("hebrew", True), 2: ("devanagari", False)}


def test_tables(spark):
    html = "<p>x</p><table><tr><th rowspan=2>A</th><td colspan='2'>B &amp; C</td></tr><tr><td>d</td><td>e</table>"
    cells = table_cells(html)
    grid = {(r, c): t for _, r, c, _, _, t, _ in cells}
    assert grid == {(0, 0): "A", (1, 0): "A", (0, 1): "B & C", (0, 2): "B & C", (1, 1): "d", (1, 2): "e"}
    inner = table_cells("<table><tr><td>o<table><tr><td>i</td></tr></table>p</td></tr></table>")
    assert {(t, x) for t, *_, x, _ in inner} >= {(1, "i")}
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    assert reshape.html_tables(df, "id", "html").count() == 6


def test_names(spark):
    names = ["a.txt", "a.txt", "a (1).txt", "a.txt", "b", "b", "a (1).txt"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = {r.i: r.new_name for r in reshape.unique_names(df, "name", ["i"]).collect()}
    assert len(set(got.values())) == len(names)
    assert got[0] == "a.txt" and got[2] == "a (1).txt" and got[4] == "b" and got[5] == "b (1)"
    assert reshape.page_names(spark.createDataFrame([("n", 7), ("n", 1234)], "n string, p int"), "n", "p").select("page_name").collect()[1][0] == "n_p1234"


def test_types_lines_chunks(spark):
    df = spark.createDataFrame([("001", "5", "1.50", None), ("2", "-7", "3", None)], "a string, b string, c string, d string")
    assert dict((r.column, r.type) for r in reshape.infer_types(df, list("abcd")).collect()) == {"a": "string", "b": "long", "c": "decimal", "d": "string"}
    t = spark.createDataFrame([(1, "a\tb\n\nc"), (2, "x\fy"), (3, "")], "id int, t string")
    assert rows(reshape.lines(t, "id", "t", "\t"), "id", "pos", "line")[:3] == [(1, 0, "a\tb"), (1, 1, ""), (1, 2, "c")]
    got = rows(reshape.chunk_lines(t, "id", "t", 2))
    assert got == [(1, 0, "a\tb\n"), (1, 1, "c"), (2, 0, "x"), (2, 1, "y"), (3, 0, "")]
    m = spark.createDataFrame([(1, "<&>\n&amp;"), (2, None)], "id int, t string")
    assert rows(reshape.to_markup(m, "id", "t"), "id", "round_trip") == [(1, True), (2, True)]


def test_sizes(spark):
    specs = spark.createDataFrame([("p", 3.0, "cm"), ("q", 51.0, "mm"), ("w", 35.0, "mm"), ("h", 45.0, "mm")], "spec string, size double, unit string")
    got = {(r.spec, r.dpi): r for r in sizing.plan_sizes(specs, spark.createDataFrame([(200,), (300,)], "dpi int")).collect()}
    assert (got["p", 200].px, got["q", 300].px, got["w", 300].px, got["h", 300].px) == (236, 602, 413, 531)
    assert round(got["p", 200].error_px, 2) == -0.22 and round(got["p", 200].error_mm, 3) == -0.028
    c = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 6, 9), ("b", 3, 50, 1), ("b", 4, 40, 1), ("c", 5, 1, 1)], "k string, id int, size int, score int")
    assert rows(sizing.pick_in_band(c, ["k"], "id", "size", "score", 5, 10), "k", "picked", "reason") == [("a", 2, "in band"), ("b", 4, "smallest above"), ("c", 5, "largest below")]
    empty = sizing.place_on_grid(c.where("false"), "k", ["id"], "score", 2, 2)
    assert empty.count() == 0


def test_jobs(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    i = spark.createDataFrame([("k", t(1), t(3), 2), ("k", t(2), t(4), 3), ("k", t(3), t(5), 1)], "k string, a timestamp, b timestamp, w int")
    r = jobs.peak_load(i, ["k"], "a", "b", "w", 4).first()
    assert (r.peak, r.peak_at, r.over) == (5, t(2), True)
    assert jobs.peak_load_overall(i, "a", "b", "w").first().peak == 5
    plan = spark.createDataFrame([("x", "f1", 1), ("x", "f2", 1), ("x", "f2", 2)], "batch string, file string, step int")
    done = plan.where("file = 'f1' or step = 1")
    assert jobs.first_unfinished(plan, done, ["batch", "file", "step"], "batch", "file", "step").first().file == "f2"
    assert jobs.assert_none(plan, plan.where("false"), "file").first().passes


def edited(rnd, text, changes):
    out = list(text)
    for _ in range(changes):
        k = rnd.randrange(len(out) + 1)
        kind = rnd.random()
        if kind < 0.4:
            out.insert(k, f"n{rnd.random()}")
        elif kind < 0.7 and k < len(out):
            out[k] = f"n{rnd.random()}"
        elif k < len(out):
            del out[k : k + rnd.choice([1, 1, 1, 30])]
    return out


def test_aligned_distance():
    """Never under the distance; equal to it for nearly all edited texts, and for texts without anchors."""
    rnd = random.Random(31)
    equal = 0
    for trial in range(300):
        vocab = [f"w{i}" for i in range(rnd.choice([3, 30, 3000]))]
        a = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 4, 60, 300]))]
        b = edited(rnd, a, rnd.randint(0, 12)) if trial % 3 else [rnd.choice(vocab) for _ in range(rnd.randint(0, 90))]
        got, want = _aligned(a, b), _edits(a, b)
        assert got >= want and (got == 0) == (a == b) and got <= max(len(a), len(b)) + abs(len(a) - len(b))
        equal += got == want
    assert equal >= 0.95 * 300


def test_aligned_similarity_of_documents(spark, data):
    from lakewright.plans import verify

    got = {r.doc_id: (r.distance, r.longest) for r in verify.v4_token_similarity(spark, data).collect()}
    want = {r.doc_id: (r.distance, r.longest) for r in verify.v4_whole_similarity(spark, data).collect()}
    assert set(got) == set(want) and len(got) > 100
    assert all(got[i][0] >= want[i][0] and got[i][1] == want[i][1] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, [], []), (2, None, ["x"]), (3, ["x"], [])], "id int, a array<string>, b array<string>")
    assert {r.id: (r.distance, r.similarity) for r in compare.aligned_similarity(odd, "a", "b").collect()} == {1: (0, 1.0), 2: (None, None), 3: (1, 0.0)}


def test_long_versions_take_linear_time():
    rnd = random.Random(5)
    a = [f"w{i}" for i in range(300_000)]
    b = edited(rnd, a, 400)
    d = _aligned(a, b)
    assert 300 < d < 8000
    assert _lcs(a, b) == _lcs_piles(a, b) >= len(a) - d


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=25), st.lists(st.sampled_from("abcdefg"), max_size=25))
def test_piles_equal_bits(a, b):
    assert _lcs_piles(a, b) == _lcs_bits(a, b) == _lcs(a, b)


def test_snapshot_with_repeated_keys(spark):
    rows = [(1, "x"), (1, "y"), (2, "z"), (2, "z"), (None, "n"), (3, None)]
    a = spark.createDataFrame(rows, "k int, v string")
    for buckets in (1, 4096):
        assert reports.snapshot_diff(a, a, ["k"], buckets).count() == 0
        assert reports.snapshot_diff(a.repartition(3), a.orderBy("v"), ["k"], buckets).count() == 0
        b = spark.createDataFrame([(1, "x"), (1, "q"), (2, "z"), (None, "n"), (3, "now"), (3, "w"), (4, None)], "k int, v string")
        got = sorted(((r.k, r.change) for r in reports.snapshot_diff(a, b, ["k"], buckets).collect()), key=str)
        assert got == [(1, "changed"), (2, "added"), (3, "changed"), (3, "removed"), (4, "removed")]
    only = reports.snapshot_diff(a.select("k"), a.select("k").distinct(), ["k"]).collect()
    assert sorted(r.k for r in only) == [1, 2] and {r.change for r in only} == {"added"}
    assert reports.snapshot_diff(a.where("false"), a, ["k"]).groupBy("change").count().collect()[0]["count"] == 6


def test_an_edge_needs_an_engine(spark):
    rules = [r for r in catalog.catalog_rules() if r.table == "raw_edges" and r.column == "engine"]
    edges = spark.createDataFrame([("a", "e1"), ("b", None), ("c", "none")], "id string, engine string")
    found = catalog.check({"raw_edges": edges, "engines": spark.createDataFrame([("e1",)], "engine string")}, rules).collect()
    assert sorted((r.rule, r.key) for r in found) == [("an edge has an engine", "b"), ("engines are known", "c")]


def test_gaps_of_a_million_ranges(spark):
    docs = spark.createDataFrame([(1, "azé😀" + chr(0x10FFFF)), (2, None), (3, "")], "id int, t string")
    many = spark.range(1_000_000).select((F.col("id") * 2 + 1).alias("lo"), (F.col("id") * 2 + 1).alias("hi"))  # odd code points
    got = {(r.id, r.character, r.n) for r in census.coverage_gaps(docs, "id", "t", many).collect()}
    assert got == {(1, c, 1) for c in "azé😀" + chr(0x10FFFF) if ord(c) % 2 == 0}
    odd = spark.createDataFrame([(None, 5), (200, 100), (-5, 97), (0x1F600, 0x7FFFFFFF)], "lo long, hi long")
    assert {r.character for r in census.coverage_gaps(docs, "id", "t", odd).collect()} == {"z", "é"}


def test_names_that_clash_again_and_again(spark):
    """More chains of made names than there were rounds."""
    rows = [(0, "a.txt"), (1, "a.txt"), *((k + 1, f"a ({k}).txt") for k in range(1, 60))]
    df = spark.createDataFrame([*rows, (100, "a.txt")], "i int, name string")
    got = [r.new_name for r in reshape.unique_names(df, "name", ["i"]).collect()]
    assert len(set(got)) == len(got) == 62
