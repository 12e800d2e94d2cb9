"""Markup: tokens, nested elements and references, against a slow reader and cases of the standard."""

import random
from html import escape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lakewright.functions import markup
from lakewright.operators import census, reshape


def made(rnd, depth=0):
    """Random well-formed markup, with its elements in order: [tag, attributes, text pieces, children]."""
    html, pieces, kids = "", [], []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.random()
        if kind < 0.4 or depth > 5:
            t = rnd.choice(["a < b", "x & y", "é", "  ", "\n", "tail>", "'q'", "ok"])
            html += escape(t, quote=rnd.random() < 0.5)
            pieces.append(t)
            pieces.append("")
        elif kind < 0.5:
            html += rnd.choice(["<!-- <div>no</div> -->", "<script>if (a<b) '<div>'</script>", "<!doctype html>", "<br>", "<!-->", "<style>p > a {}</style>"])
        else:
            tag, own = rnd.choice(["div", "span", "b"]), rnd.choice([{}, {"title": "x > y"}, {"class": "it's", "id": "n1"}])
            inner, texts, below = made(rnd, depth + 1)
            attributes = "".join(f' {k.upper()}="{v}"' for k, v in own.items())
            html += f"<{tag}{attributes}>{inner}</{tag.upper()} >"
            kids.append((tag, own, texts, below))
            pieces.extend(texts)
        html += "<i></i>"  # parts what would be one piece of text
    return html, pieces, kids


def flat(kids):
    for tag, own, texts, below in kids:
        yield tag, own, " ".join(" ".join(texts).split())
        yield from flat(below)


def test_nested_elements():
    rnd = random.Random(5)
    for _ in range(400):
        html, pieces, kids = made(rnd)
        got = markup.elements(html, frozenset({"div", "span", "b"}))
        want = list(flat(kids))
        assert [(x[3], x[4], x[5]) for x in got] == want, html
        assert markup.text_of(html) == " ".join(" ".join(pieces).split())
        for own, parent, depth, *_ in got:
            assert (parent is None) == (depth == 0) and (parent is None or got[parent][2] == depth - 1 and parent < own)


def test_equal_tags_and_ends_left_out():
    text = {x[0]: (x[1], x[2], x[5]) for x in markup.elements("<div>a<div>b<div>c</div>d</div>e</div>f", frozenset({"div"}))}
    assert text == {0: (None, 0, "a b c d e"), 1: (0, 1, "b c d"), 2: (1, 2, "c")}
    assert [x[5] for x in markup.elements("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>", frozenset({"li"}))] == ["1 2 3", "2", "3", "4"]
    assert [x[5] for x in markup.elements("<p>1<p>2<div>3</p>4</div>5", frozenset({"p"}))] == ["1", "2"]
    assert [x[5] for x in markup.elements("<table><tr><td>1<td>2<table><tr><td>3</table>4<tr><td>5</table>", frozenset({"td"}))] == ["1", "2 3 4", "3", "5"]
    assert [x[5] for x in markup.elements("<a href=x>1<a>2</a>3", frozenset({"a"}))] == ["1", "2"]


def test_references():
    for name, value in html5.items():
        if name.endswith(";") and value not in ("\xa0", " ", "\t", "\n"):
            assert markup.decoded(f"a&{name}b") == f"a{value}b", name
    cases = {
        "caf&eacute; &#8217;x&#x27; &hellip;": "café ’x' …", "&amp;lt;": "&lt;", "&lt;b&gt;": "<b>", "&#128;": "€", "&#0;": "�", "&#xD800;": "�",
        "&notit;": "¬it;", "&notin;": "∉", "&copy 1": "© 1", "&unknown;": "&unknown;", "a & b": "a & b", "&": "&", "&#;": "&#;", "&nbsp;x&#160;&#xA0;y": " x  y",
    }
    for given, want in cases.items():
        assert markup.decoded(given) == want, given


@pytest.mark.parametrize("html, want", [
    ("<a href='?a=1&copy=2&lt=3'>", {"href": "?a=1&copy=2&lt=3"}), ("<a href=?a=1&amp;b=2>", {"href": "?a=1&b=2"}), ("<a title='&eacute;&#39;&copy'>", {"title": "é'©"}),
    ("<a b=1 B=2 c>", {"b": "1", "c": ""}), ("<a b = 'x>y' c=\"'\"/>", {"b": "x>y", "c": "'"}), ("<a b=it's>", {"b": "it's"}), ("<a =b=c>", {"=b": "c"}), ("<a b=>", {"b": ""}),
    ("<a title='&copycat;'>", {"title": "&copycat;"}),
])
def test_attributes(html, want):
    assert [t for t in markup.tokens(html) if t[0] == "open"] == [("open", "a", want)]


class Slow(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_pages_as_a_slow_reader_has_them(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in reshape.html_text(pages, "page_id", "html").collect()}
    for r in pages.collect():
        slow = Slow()
        slow.feed(r.html or "")
        slow.close()
        assert got[r.page_id].split() == " ".join(slow.parts).split()


def test_unended_and_hostile():
    assert markup.text_of("a<!-- b") == "a" and markup.text_of("a<b title='x") == "a" and markup.text_of("a < b <3 </>c") == "a < b <3 c"
    assert markup.text_of("<script>a</script >b<style>c") == "b" and markup.text_of("<title>a<b>&amp;</title>c") == "a<b>& c"
    assert markup.text_of("") == "" and markup.elements("") == []
    assert markup.text_of("<a '" * 100_000) == ""  # linear
    assert len(markup.elements("<b>" * 20_000 + "x" + "</b>" * 20_000, frozenset())) == 0


def test_operators_with_odd_rows(spark):
    page = "<div class=a>1<div>2 &eacute;</div></div><!-- <a href=x> --><a href='u'>l</a><a name=n>m</a><h2>t</h2>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, "<div>z")], "id long, html string")
    for c in ("text", "ord", "tag", "n", "feature"):
        df = df.withColumn(c, F.lit("clash"))
    got = {(r.id, r.ord, r.attribute, r.text) for r in reshape.html_elements(df, "id", "html", "div", "class").collect()}
    assert got == {(1, 0, "a", "1 2 é"), (1, 1, "", "2 é"), (None, 0, "", "z")}
    tree = {(r.ord, r.parent, r.depth, r.tag) for r in reshape.element_tree(df.where("id = 1"), "id", "html").collect()}
    assert tree == {(0, None, 0, "div"), (1, 0, 1, "div"), (2, None, 0, "a"), (3, None, 0, "a"), (4, None, 0, "h2")}
    assert {r.id: r.text for r in reshape.html_text(df, "id", "html").collect()} == {1: "1 2 é l m t", 2: None, 3: "", None: "z"}
    assert {(r.id, r.feature, r.n) for r in census.feature_census(df, "id", "html").collect()} == {(1, "links", 1), (1, "headings", 1)}
    assert reshape.html_elements(df.where("false"), "id", "html", "div").count() == 0


def test_scripts_in_one_pass(spark):
    df = spark.createDataFrame([(1, "abc λμ 12 שלום 漢字"), (2, None), (3, ""), (4, "é\U0001f600́x"), (None, "д")], "id long, t string")
    got = {(r.id, r.script, r.n) for r in census.script_census(df, "id", "t").collect()}
    assert got == {(1, "latin", 3), (1, "greek", 2), (1, "digits", 2), (1, "hebrew", 4), (1, "han", 2), (4, "latin", 2), (None, "cyrillic", 1)}
    both = census.script_census(df, "id", "t", {"letters": r"\p{L}", "latin": r"\p{IsLatin}"})
    assert {(r.script, r.n) for r in both.where("id = 1").collect()} == {("letters", 11), ("latin", 3)}


def test_script_census_of_long_texts_in_slices(spark, monkeypatch):
    """Python's memory for a long text is that of a slice besides the text itself."""
    monkeypatch.setattr(census, "SLICE", 7)
    texts = ["", None, "abc" * 9 + "é1", "", "дд1", "x" * 7, "", "я" * 30 + "9", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = {(r.id, r.script): r.n for r in census.script_census(df, "id", "t").collect()}
    assert got == {(2, "latin"): 28, (2, "digits"): 1, (4, "cyrillic"): 2, (4, "digits"): 1, (5, "latin"): 7, (7, "cyrillic"): 30, (7, "digits"): 1}


def test_script_census_memory(spark):
    """A text of 8 million characters needs under 64 MB of arrays besides itself."""
    import tracemalloc

    import pyarrow as pa

    made = []
    census_rows = type("Rows", (), {"select": lambda self, *c: self, "schema": spark.range(1).schema, "mapInArrow": lambda self, run, schema: made.append(run)})()
    census.script_census(census_rows, "id", "t")
    batch = pa.RecordBatch.from_pydict({"id": [1], "t": ["a" * 8_000_000]})
    tracemalloc.start()
    rows = [r for b in made[0](iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [{"id": 1, "script": "latin", "n": 8_000_000}] and peak < 64e6, peak
