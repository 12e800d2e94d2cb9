"""A small catalogue of our own, loaded, checked, planned and reported."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators import catalog, losses, paths, reports

FEATURES = {"tables": {"label": "Tables", "visual": False}, "fonts": {"label": "Fonts", "visual": True}, "macros": {"label": "Macros", "visual": False}}


def fmt(label, roles, caps, **more):
    return {"short": label, "label": label, "ext": [label.lower()], "roles": roles, "caps": dict(zip(FEATURES, caps, strict=True)), **more}


FORMATS = {
    "a": fmt("A", ["source", "target"], ["full", "full", "full"], targetModes=["exact", "editable"]),
    "old": fmt("Old", ["source"], ["full", "partial", "none"], normalizeTo="a", sourceCaps={"macros": "full"}),
    "hub": fmt("Hub", ["source", "target"], ["partial", "full", "none"], transit=True, targetModes=["exact"]),
    "pix": fmt("Pix", ["target"], ["none", "none", "none"], targetModes=["exact"], pixels=True),
    "txt": fmt("Txt", ["source", "target"], ["none", "none", "none"], targetModes=["editable"]),
}
ROUTES = {
    "engines": {"e1": {"label": "One", "detail": ""}, "ocr": {"label": "OCR", "detail": ""}},
    "edges": [
        {"id": "norm", "engine": "e1", "pairs": [["old", "a"]], "modes": {"exact": 0, "editable": 0}, "summary": "n", "losses": []},
        {"id": "up", "engine": "e1", "from": ["a", "txt"], "to": ["hub"], "modes": {"exact": 1.5, "editable": 1}, "summary": "u", "losses": {"*": ["general"], "hub": [{"text": "macros go", "ifSourceHas": "macros"}]}},
        {"id": "paint", "engine": "ocr", "from": ["hub"], "to": ["pix"], "modes": {"exact": 0.25}, "finalOnly": True, "summary": "p", "losses": ["flat"]},
        {"id": "plain", "engine": "e1", "from": ["a", "hub"], "to": ["txt"], "modes": {"editable": 2}, "summary": "t", "losses": []},
    ],
    "overrides": [{"source": "a", "target": "txt", "modes": ["editable"], "chain": ["a", "hub", "txt"], "reason": "better"}],
}


def loaded(spark, tmp_path, formats=None, routes=None):
    d = tmp_path / "main"
    d.mkdir()
    (d / "formats.json").write_text(json.dumps({"features": FEATURES, "formats": formats or FORMATS}))
    (d / "routes.json").write_text(json.dumps(routes or ROUTES))
    return catalog.load_catalog(spark, str(d / "formats.json"), str(d / "routes.json"))


def planned(t):
    nodes = t["formats"].select(F.col("format").alias("node"), "transit", "normalize_to")
    src = t["formats"].where(F.array_contains("roles", "source")).select(F.col("format").alias("node"))
    dst = t["formats"].where(F.array_contains("roles", "target")).select(F.col("format").alias("node"))
    return paths.apply_overrides(paths.cheapest_paths(t["edges"], nodes, src, dst), t["overrides"].drop("catalog"), t["edges"])


def test_load_and_plan(spark, tmp_path):
    t = loaded(spark, tmp_path)
    assert t["edges"].count() == 9 and t["caps"].count() == 15
    assert catalog.check(t, catalog.catalog_rules()).collect() == []
    routes = planned(t)
    got = {(r.source, r.target, r.mode): (tuple(r.chain), float(r.cost), r.override_reason) for r in routes.collect()}
    assert got["old", "pix", "exact"] == (("old", "a", "hub", "pix"), 1.75, None)
    assert got["a", "txt", "editable"] == (("a", "hub", "txt"), 3.0, "better")
    assert got["old", "txt", "editable"] == (("old", "a", "txt"), 2.0, None)
    assert ("txt", "pix", "exact") in got and ("a", "pix", "editable") not in got

    lv = lambda df: df.select("format", "feature", catalog.level(F.col("level")).alias("level"))
    lost = losses.path_losses(routes, lv(t["caps"]), lv(t["source_caps"]))
    assert {(r.feature, r.level) for r in lost.where("source = 'old' and target = 'pix'").collect()} == {("tables", "lost"), ("fonts", "lost"), ("macros", "lost")}
    have = catalog.overlay(lv(t["caps"]), lv(t["source_caps"]), ["format", "feature"], "level")
    steps = losses.step_losses(routes, t["edge_losses"], have)
    texts = {(r.source, r.target, r.mode): r.texts for r in steps.collect()}
    assert texts["old", "pix", "exact"] == ["general", "macros go", "flat"]
    assert texts["txt", "pix", "exact"] == ["general", "flat"]
    said = losses.summarise_losses(routes, lost, steps, t["formats"], t["features"])
    text = {(r.source, r.target, r.mode): r.summary for r in said.collect()}
    assert text["old", "pix", "exact"] == "Flattened to pixels; Lost: Tables, Macros; general; macros go; flat"
    assert text["old", "a", "exact"] == "None expected"

    held = paths.path_invariants(routes.where("override_reason is null"), t["edges"], t["formats"].select(F.col("format").alias("node"), "transit", "normalize_to"), "txt")
    assert held.where("not all_hold").count() == 0
    grid = {r.source: r.asDict() for r in reports.route_grid(routes, t["edges"], ["a", "hub", "pix", "txt"]).collect()}
    assert grid["old"]["pix"] == "e3*" and "e2!" in grid["a"]["txt"] and grid["a"]["a"] == "·"
    roll = {r.edge_id: r for r in reports.edge_rollup(t["edges"], t["edge_losses"]).collect()}
    assert roll["up"].pairs == "a>hub, txt>hub" and roll["up"].losses == "general; macros go"
    record = json.loads(reports.export_routes(routes, t["edges"], lost, steps).where("source = 'old' and target = 'pix'").first().record)
    assert [s["edge_id"] for s in record["steps"]] == ["norm", "up", "paint"] and record["potential_losses"][0]["feature"] == "fonts"
    assert paths.all_requests(t["formats"]).count() == 16

    asked = spark.createDataFrame([("a", "pix", "editable"), ("pix", "a", "exact"), ("a", "old", "exact"), ("a", "a", "exact"), ("a", "pix", "best"), ("hub", "a", "exact")], "source string, target string, mode string")
    out = {(r.source, r.target, r.mode): r.reject_reason for r in paths.plan_requests(asked, t["formats"], routes, catalog.MODES).collect()}
    assert out == {("a", "pix", "editable"): None, ("pix", "a", "exact"): "not a source", ("a", "old", "exact"): "not a target", ("a", "a", "exact"): "same format", ("a", "pix", "best"): "unknown mode", ("hub", "a", "exact"): "no route"}
    assert catalog.membership(t["formats"], "roles", "target").count() == 4


def test_two_catalogues_at_once(spark, tmp_path):
    other = json.loads(json.dumps(ROUTES))
    other["edges"][1]["modes"] = {"exact": 9}
    for name, routes in (("x", ROUTES), ("y", other)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "formats.json").write_text(json.dumps({"features": FEATURES, "formats": FORMATS}))
        (tmp_path / name / "routes.json").write_text(json.dumps(routes))
    t = catalog.load_catalog(spark, f"{tmp_path}/*/formats.json", f"{tmp_path}/*/routes.json")
    nodes = t["formats"].select("catalog", F.col("format").alias("node"), "transit", "normalize_to")
    ends = t["formats"].select("catalog", F.col("format").alias("node"), "roles")
    routes = paths.cheapest_paths(t["edges"], nodes, ends.where("array_contains(roles, 'source')"), ends.where("array_contains(roles, 'target')"), keys=("catalog", "mode"))
    cost = {(r.catalog, r.source, r.target, r["mode"]): float(r.cost) for r in routes.collect()}
    assert cost["x", "old", "pix", "exact"] == 1.75 and cost["y", "old", "pix", "exact"] == 9.25 and ("y", "txt", "hub", "editable") not in cost
    lv = lambda df: df.select("catalog", "format", "feature", catalog.level(F.col("level")).alias("level"))
    lost = losses.path_losses(routes, lv(t["caps"]), lv(t["source_caps"]))
    steps = losses.step_losses(routes, t["edge_losses"], catalog.overlay(lv(t["caps"]), lv(t["source_caps"]), ["catalog", "format", "feature"], "level"))
    said = losses.summarise_losses(routes, lost, steps, t["formats"], t["features"])
    assert said.count() == routes.count()
    planned = paths.plan_requests(paths.all_requests(t["formats"]), t["formats"], routes, catalog.MODES)
    got = {(r.catalog, r.source, r.target, r["mode"]): r.cost and float(r.cost) for r in planned.collect()}
    assert len({k[0] for k in got}) == 2 and all(got[k] == cost.get(k) for k in got)


def test_missing_edge_of_an_override(spark, tmp_path):
    t = loaded(spark, tmp_path, routes={**ROUTES, "overrides": [{"source": "hub", "target": "a", "modes": ["exact"], "chain": ["hub", "a"], "reason": "x"}]})
    r = planned(t).where("source = 'hub' and target = 'a'").first()
    assert r.error == "no edge hub > a" and r.cost is None


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda f, r: f["a"]["caps"].pop("fonts"), "caps are complete"),
        (lambda f, r: f["a"]["caps"].update(tables="lots"), "caps have known levels"),
        (lambda f, r: f["a"]["caps"].update(smell="full"), "caps name known features"),
        (lambda f, r: f["a"].update(targetModes=["fast"]), "target modes are known"),
        (lambda f, r: f["a"].update(targetModes=[]), "a target has modes"),
        (lambda f, r: f["old"].update(normalizeTo="gone"), "normalised form is known"),
        (lambda f, r: r["edges"].append(dict(r["edges"][0])), "edge ids are unique"),
        (lambda f, r: r["edges"][0].update(modes={"exact": -1}), "costs aren't negative"),
        (lambda f, r: r["edges"][0].update(modes={}), "an edge has modes"),
        (lambda f, r: r["edges"][0].update(engine="none"), "engines are known"),
        (lambda f, r: r["edges"][0].update(pairs=[["a", "nowhere"]]), "edge targets are known"),
        (lambda f, r: r["edges"][0].update(pairs=[["a", "a"]]), "no edge leads to itself"),
        (lambda f, r: r["edges"][1].update(losses=[{"text": "x", "ifSourceHas": "smell"}]), "losses name known features"),
        (lambda f, r: r["overrides"][0].update(chain=["hub", "txt"]), "an override's chain has its ends"),
    ],
)
def test_rules(spark, tmp_path, change, rule):
    f, r = json.loads(json.dumps(FORMATS)), json.loads(json.dumps(ROUTES))
    change(f, r)
    found = {x.rule for x in catalog.check(loaded(spark, tmp_path, f, r), catalog.catalog_rules()).collect()}
    assert rule in found


def brute(edges, transit, normal, source, target, mode, most):
    best = None

    def walk(node, cost, costs, ords, chain):
        nonlocal best
        if node == target and ords:
            key = (cost, len(ords), costs[::-1], ords)
            best = min(best, (key, chain)) if best else (key, chain)
            return
        if len(ords) == most or not (node == source or node in transit or node == normal.get(source)):
            return
        for o, a, b, m, c, last in edges:
            if a == node and m == mode and b not in chain and (not last or b == target):
                walk(b, cost + c, [*costs, cost], [*ords, o], [*chain, b])

    walk(source, 0, [], [], [source])
    return best


def test_cheapest_paths_by_brute_force(spark):
    rnd = random.Random(5)
    names = list("abcdefg")
    edges = []
    for o, (a, b) in enumerate(itertools.permutations(names, 2)):
        if rnd.random() < 0.5:
            edges.append((o, a, b, rnd.choice(["x", "y"]), rnd.randint(0, 4), rnd.random() < 0.2))
    transit, normal = {"b", "c", "d"}, {"a": "e"}
    e = spark.createDataFrame(edges, "edge_ord long, src string, dst string, mode string, cost long, final_only boolean")
    n = spark.createDataFrame([(x, x in transit, normal.get(x)) for x in names], "node string, transit boolean, normalize_to string")
    got = {(r.source, r.target, r.mode): (r.cost, list(r.edge_ords)) for r in paths.cheapest_paths(e, n, n, n).collect()}
    for s, t, m in itertools.product(names, names, "xy"):
        want = brute(edges, transit, normal, s, t, m, 7) if s != t else None
        assert got.get((s, t, m)) == (want and (want[0][0], want[0][3])), (s, t, m)


def _paths(spark, edges, **more):
    e = spark.createDataFrame([(i, a, b, "exact", c, f) for i, (a, b, c, f) in enumerate(edges)], "edge_ord long, src string, dst string, mode string, cost long, final_only boolean")
    names = sorted({x for a, b, *_ in edges for x in (a, b)})
    n = spark.createDataFrame([(x, True, None) for x in names], "node string, transit boolean, normalize_to string")
    return {(r.source, r.target): (r.cost, r.hops, "".join(r.chain)) for r in paths.cheapest_paths(e, n, n, n, **more).collect()}


def test_long_paths(spark):
    chain = "abcdefghijk"
    got = _paths(spark, [(x, y, 1, y == "k") for x, y in zip(chain, chain[1:], strict=False)])
    assert got[("a", "k")] == (10, 10, chain)


def test_limit_on_hops(spark):
    edges = [("s", "a", 1, False), ("a", "b", 1, False), ("s", "b", 5, False), ("b", "t", 1, True)]
    assert _paths(spark, edges)[("s", "t")] == (3, 3, "sabt")
    assert _paths(spark, edges, max_hops=2)[("s", "t")] == (6, 2, "sbt")
    assert ("s", "t") not in _paths(spark, edges, max_hops=1)


def test_catalogues_beside_each_other(spark):
    """Ids and names count within a catalogue; overrides without modes mean both."""
    raw = spark.createDataFrame([("x", 0, "e1"), ("y", 0, "e1"), ("y", 1, ""), ("y", 2, None)], "catalog string, raw_ord int, id string")
    ranks = spark.createDataFrame([("x", "f", "n1"), ("y", "g", "n1")], "catalog string, format string, normalize_to string")
    names = spark.createDataFrame([("x", "n1")], "catalog string, format string")
    found = catalog.check(
        {"raw": raw, "formats": ranks, "known": names},
        [
            catalog.Rule("unique", "raw", "unique", ["id"]), catalog.Rule("id", "raw", "row_expr", ["raw_ord"], expr="id <> ''"),
            catalog.Rule("known", "formats", "fk", ["format"], "normalize_to", to="known", other="format"),
            catalog.Rule("cross", "formats", "complete_cross", axes=(("formats", "format"), ("known", "format")), columns=("format", "normalize_to")),
        ],
    )
    assert sorted((r.rule, r.key) for r in found.collect()) == [("id", "y|1"), ("id", "y|2"), ("known", "y|g")]


def test_pairs_of_many(spark):
    raw = spark.createDataFrame([(0, "e", [str(i) for i in range(120)], [str(i) for i in range(120)], {"exact": 1.0}), (1, "f", ["a"], ["b"], {"exact": 1.0})], "raw_ord int, id string, `from` array<string>, `to` array<string>, modes map<string, double>")
    raw = raw.selectExpr("*", "cast(null as array<array<string>>) pairs", "'g' engine", "false finalOnly", "'' summary")
    rows = catalog.expand_edges(raw).orderBy("edge_ord").select("edge_ord", "edge_id").collect()
    assert len({r.edge_ord for r in rows}) == 120 * 120 + 1 and rows[-1].edge_id == "f"
