"""Queries against their SQL on small tables of odd rows."""

import pytest

from lakewright.plans import corpus, registry, verify  # noqa: F401


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives its SQL's rows on tables made here, {name: (rows, schema)}."""
    import duckdb

    def check(name: str, tables: dict) -> list[tuple]:
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        cur = con.execute(registry.SQL[name])
        names = [x[0] for x in cur.description]
        want = sorted(cur.fetchall(), key=repr)
        got = sorted((tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()), key=repr)
        assert got == want
        return got

    return check


PAGES = "page_id long, url string, html string"


def test_names_that_end_twice(same):
    urls = ["http://a/5", "http://a/6.html", "http://b/6.html", "http://b/6.html?x=1", "http://c/5#y", "http://a/x.htmly", "http://b/x.htmly", "http://a/", "http://b/"]
    got = same("x10_names", {"pages": ([(k, u, "") for k, u in enumerate(urls)], PAGES)})
    assert {r[2] for r in got} >= {"6.html.html", "6 (1).html", "6 (2).html", "5.html", "5 (1).html"}


CUT = [
    (1, "http://A.com/1", "<h1>a&amp;&amp</h1><p>b&amp; &quot c &lt;&gt;</p>"), (2, "http://b.com/2", "<a href=\"u\">x &amp;am</a> &copy; &copy &amp;lt; &am &a;"),
    (3, "http://c.com/3", "<h1>q&quot</h1><h1>&nbsp;r&amp</h1><a>&amp</a>&middot;&#39;&#39 &apos;&bogus;"), (4, "http://d.com/4", ""),
]


@pytest.mark.parametrize("name", ["x3_text", "x2_elements"])
def test_references_that_were_cut(same, name):
    assert "&amp" in repr(same(name, {"pages": (CUT, PAGES)}))


def test_closed_references():
    from lakewright.functions.markup import decoded

    assert decoded("&eacute;&eacute &#233;&#233 &#xa0;&nbsp;&ampx;&amp;lt;", closed=True) == "é&eacute é&#233   &ampx;&lt;"
    assert decoded("&amp&lt") == "&<"


def test_titles_that_were_cut(same):
    assert "&amp" in repr(same("x9_outline", {"pages": (CUT, PAGES)}))


DOCS = [(1, "a b a\tc  d"), (2, "a b\nb"), (3, None), (4, ""), (5, "x y z x y z x"), (6, "z y x"), (8, "q"), (10, " é\r\n日本 é "), (11, "é 日本\fé k"), (13, "a"), (None, "a a n"), (None, "n")]


@pytest.mark.parametrize("name", ["v3_context", "v3_multiset_diff"])
def test_differences_of_texts(same, name):
    assert len(same(name, {"documents": (DOCS, "doc_id long, text string")})) > 12


def test_differences_of_repeated_ids(same):
    rows = [*DOCS, (1, "a c"), (2, "b b d"), (2, "b b d"), (5, None)]
    same("v3_multiset_diff", {"documents": (rows, "doc_id long, text string")})


def test_differences_shuffle_no_tokens(spark, data):
    """Tokens and contexts stay in the task that counts them: texts alone go through an exchange."""
    for name in ("v3_context", "v3_multiset_diff"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("name", ["v14_report", "v14_report_files"])
def test_reports_of_a_share_for_a_task(spark, same, monkeypatch, name):
    """Orders are dealt out by their number, and reports are grouped and labelled where their checks are made."""
    import lakewright.sources.files as files

    monkeypatch.setattr(verify, "SHARE", 7)
    monkeypatch.setattr(files, "FILE_BYTES", 2_000)
    orders = [(k, k % 5, "OFP"[k % 3]) for k in range(1, 100)]
    assert len(same(name, {"orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string")})) > 80


def test_a_task_holds_a_share_of_the_reports(spark, data, monkeypatch):
    monkeypatch.setattr(verify, "SHARE", 100)
    n = -(-spark.read.parquet(f"{data}/orders.parquet").count() // 100)
    assert n > 1 and registry.QUERIES["v14_report"](spark, data).rdd.getNumPartitions() == n


def test_catalogues_are_read_once_for_edges_and_losses(spark, data):
    from lakewright.plans import graph  # noqa: F401

    plan = registry.QUERIES["g1_load_catalog"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # formats and routes


def test_token_arrays_one_pair_at_a_time():
    import pyarrow as pa

    from lakewright.functions import text

    a, b = pa.array([["z"], ["a", "b"], None, [], ["x", None]]).slice(1), pa.array([["z"], ["b", "c"], ["x"], [], [None]]).slice(1)
    assert text._each(text._lcs, a, b).to_pylist() == [1, None, 0, 1]
    assert text._each(text._edits, a, b).to_pylist() == [2, None, 0, 1]
