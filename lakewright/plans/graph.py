"""Queries of the catalogue and path operators, over a graph of nations: an edge leads from a supplier's
nation to a customer's, its cost is the number of lines; nations of the first region may be passed
through; an edge into another region's first nation may only end a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, losses, paths, reports
from ..sources.files import table
from .registry import query


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("_first"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    by_order = line.join(s, "l_suppkey").groupBy("l_orderkey", "src").agg(F.count(F.lit(1)).alias("n"))
    e = by_order.join(o, "l_orderkey").join(c, "o_custkey").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("cost"))
    a = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("_a"))
    b = n.join(first, "n_regionkey").select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("_b"), "_first")
    return e.join(a, "src").join(b, "dst").select(
        (F.col("src") * 1000 + F.col("dst")).cast("long").alias("edge_ord"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cost",
        F.lit("exact").alias("mode"), ((F.col("dst") == F.col("_first")) & (F.col("_a") != F.col("_b"))).alias("final_only"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") == 0).alias("transit"), F.lit(None).cast("long").alias("normalize_to"))


def routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, n = edges(spark, d), nodes(spark, d)
    return paths.cheapest_paths(e, n, n, n), e


EDGES = """edges AS (
 SELECT s.s_nationkey::BIGINT AS src, c.c_nationkey::BIGINT AS dst, count(*) AS cost,
  s.s_nationkey::BIGINT * 1000 + c.c_nationkey AS ord,
  (c.c_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey) AND a.n_regionkey <> b.n_regionkey) AS final_only
 FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
 JOIN nation a ON a.n_nationkey = s.s_nationkey JOIN nation b ON b.n_nationkey = c.c_nationkey
 WHERE s.s_nationkey <> c.c_nationkey GROUP BY ALL)"""
PATHS = f"""WITH RECURSIVE {EDGES},
walk AS (
 SELECT src AS source, dst AS node, cost, 1 AS hops, [0::BIGINT] AS back, [ord] AS ords, [src, dst] AS chain, final_only FROM edges
 UNION ALL
 SELECT w.source, e.dst, w.cost + e.cost, w.hops + 1, list_prepend(w.cost, w.back), list_append(w.ords, e.ord), list_append(w.chain, e.dst), e.final_only
 FROM walk w JOIN edges e ON e.src = w.node JOIN nation n ON n.n_nationkey = w.node
 WHERE n.n_regionkey = 0 AND NOT w.final_only AND NOT list_contains(w.chain, e.dst) AND w.hops < 7),
best AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY cost, hops, back, ords) = 1)"""


@query("SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def g1_explode_json(spark: SparkSession, d: str) -> DataFrame:
    return catalog.explode_json(table(spark, d, "events"), ["event_id"], "props")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) - 1 AS ord FROM lineitem)
SELECT l_orderkey AS catalog, ord * 4294967296 AS edge_ord, 's' || l_suppkey AS src, 'p' || l_partkey AS dst, m AS mode, (CASE m WHEN 'exact' THEN l_quantity ELSE l_tax END)::DOUBLE AS cost, l_returnflag = 'R' AS final_only, 'part ' || l_partkey AS label,
 'all' || CASE WHEN l_linestatus = 'O' THEN ';one?segment' ELSE '' END AS losses FROM l, (SELECT unnest(['exact', 'editable']) AS m)""")
def g1_load_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a catalogue of two JSON texts, read back as tables: its edges with their target's label
    and losses."""
    sup, part = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    lost = F.when(F.col("l_linestatus") == "O", F.concat(F.lit('{"*":["all"],"'), part, F.lit('":[{"text":"one","ifSourceHas":"segment"}]}'))).otherwise(F.lit('["all"]'))
    edge = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("string").alias("id"), F.lit("truck").alias("engine"), F.array(sup).alias("from"), F.array(part).alias("to"),
        "l_quantity", "l_tax", F.when(F.col("l_returnflag") == "R", True).alias("finalOnly"), lost.alias("losses"),
    )
    labels = F.array(F.struct(sup.alias("key"), F.struct(F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("label"))), F.struct(part.alias("key"), F.struct(F.concat(F.lit("part "), F.col("l_partkey")).alias("label"))))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(edge)).alias("edges"), F.array_distinct(F.flatten(F.collect_list(labels))).alias("formats"))

    def document(e: Column) -> Column:
        modes = F.create_map(F.lit("exact"), e["l_quantity"], F.lit("editable"), e["l_tax"])
        return e.dropFields("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").withField("modes", modes)

    texts = orders.select(
        "l_orderkey", F.to_json(F.struct(F.map_from_entries("formats").alias("formats"))).alias("f"),
        F.to_json(F.struct(F.transform("edges", document).alias("edges"))).alias("r"),
    )
    t = catalog.parse_catalogs(texts, "l_orderkey", "f", "r")
    said = F.transform("losses", lambda x: F.concat_ws("?", x["text"], x["if_source_has"]))
    e = t["expanded"].withColumn("losses", F.when(F.size("losses") > 0, F.array_join(said, ";")))  # each edge has its losses, so they need no join
    e = e.join(t["formats"].select("catalog", F.col("format").alias("dst"), "label"), ["catalog", "dst"])
    return e.select("catalog", "edge_ord", "src", "dst", "mode", F.col("cost").cast("double").alias("cost"), "final_only", "label", "losses")


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN [[p_brand, p_type]] ELSE list_transform(string_split(p_type, ' '), lambda x: [p_brand, x]) END AS pairs FROM part),
e AS (SELECT *, unnest(pairs) AS pair, unnest(range(len(pairs))) AS k FROM p)
SELECT p_partkey * 4294967296 + k AS edge_ord, p_partkey::VARCHAR AS edge_id, pair[1] AS src, pair[2] AS dst, m AS mode, (CASE m WHEN 'exact' THEN p_size ELSE p_retailprice END)::DOUBLE AS cost, p_size > 40 AS final_only, p_name AS summary
 FROM e, (SELECT unnest(['exact', 'editable']) AS m) WHERE m = 'exact' OR p_size % 2 = 0""")
def g2_expand_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each part as an edge from its brand to the words of its type, or to the type by a given pair."""
    p, size = table(spark, d, "part"), F.col("p_size")
    raw = p.select(
        F.col("p_partkey").alias("raw_ord"), F.col("p_partkey").cast("string").alias("id"), F.lit("press").alias("engine"), F.array("p_brand").alias("from"), F.split("p_type", " ").alias("to"),
        F.when(size % 3 == 0, F.array(F.array("p_brand", "p_type"))).alias("pairs"), F.when(size > 40, True).alias("finalOnly"), F.col("p_name").alias("summary"),
        F.map_filter(F.create_map(F.lit("exact"), size.cast("double"), F.lit("editable"), F.when(size % 2 == 0, F.col("p_retailprice"))), lambda _, v: v.isNotNull()).alias("modes"),
    )
    return catalog.expand_edges(raw).drop("engine").withColumn("cost", F.col("cost").cast("double"))


@query("""SELECT a.n_regionkey::BIGINT AS region, a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst,
 row_number() OVER (PARTITION BY a.n_regionkey ORDER BY a.n_nationkey, b.n_nationkey) - 1 AS pos
 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def g2_expand_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("k"))
    lists = n.groupBy("region").agg(F.array_sort(F.collect_list("k")).alias("l"))
    pair = F.posexplode(catalog.expand_pairs(F.lit(None).cast("array<array<bigint>>"), F.col("l"), F.col("l"))).alias("pos", "p")
    return lists.select("region", pair).select("region", F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"), F.col("pos").cast("long").alias("pos"))


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def g3_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select("doc_id", F.lit(-1).cast("long").alias("quality"))
    return catalog.overlay(base, table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), ["doc_id"], "quality")


@query("""SELECT 'order has a customer' AS rule, o_orderkey::VARCHAR AS key, o_custkey::VARCHAR AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'lines are unique', l_orderkey || '|' || l_linenumber, count(*) || ' rows' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'quantity in range', l_orderkey || '|' || l_linenumber, (l_quantity::BIGINT)::VARCHAR FROM lineitem WHERE l_quantity < 2 OR l_quantity > 45
UNION ALL SELECT 'known event type', event_id::VARCHAR, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')
UNION ALL SELECT 'every nation has every segment', n_nationkey || '|' || c_mktsegment, 'missing' FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)
 WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = n_nationkey AND x.c_mktsegment = customer.c_mktsegment AND x.c_custkey % 7 = 0)""".replace("(SELECT DISTINCT c_mktsegment FROM customer)\n", "(SELECT DISTINCT c_mktsegment FROM customer) AS customer\n"))
def g4_integrity(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    tables = {
        "orders": table(spark, d, "orders"), "customer": customer.where("c_custkey % 50 <> 0"), "nation": table(spark, d, "nation"), "every": customer,
        "lines": table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), "events": table(spark, d, "events"),
        "some": customer.where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")),
    }
    return catalog.check(tables, [
        catalog.Rule("order has a customer", "orders", "fk", ["o_orderkey"], "o_custkey", to="customer", other="c_custkey"),
        catalog.Rule("lines are unique", "lines", "unique", ["l_orderkey", "l_linenumber"]),
        catalog.Rule("quantity in range", "lines", "range", ["l_orderkey", "l_linenumber"], "q", low=2, high=45),
        catalog.Rule("known event type", "events", "in_set", ["event_id"], "event_type", ("view", "click", "purchase", "signup")),
        catalog.Rule("every nation has every segment", "some", "complete_cross", axes=(("nation", "n_nationkey"), ("every", "c_mktsegment")), columns=("n", "s")),
    ])


@query(PATHS + " SELECT source, node AS target, cost::BIGINT AS cost, hops::BIGINT AS hops, array_to_string(chain, '-') AS chain FROM best")
def g5_cheapest_paths(spark: SparkSession, d: str) -> DataFrame:
    r, _ = routes(spark, d)
    return r.select("source", "target", F.col("cost").cast("long").alias("cost"), F.col("hops").cast("long").alias("hops"), F.concat_ws("-", F.col("chain").cast("array<string>")).alias("chain"))


def pinned(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("source")), n.where("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("target"))
    return a.crossJoin(b).select("source", "target", F.lit("exact").alias("mode"), F.array("source", F.lit(5).cast("long"), "target").alias("chain"), F.lit("by hand").alias("reason"))


@query(PATHS + """, pins AS (SELECT a.n_nationkey::BIGINT AS source, b.n_nationkey::BIGINT AS target FROM nation a, nation b WHERE a.n_regionkey = 1 AND b.n_regionkey = 2)
SELECT source, node AS target, cost::BIGINT AS cost, array_to_string(chain, '-') AS chain, '' AS reason FROM best WHERE (source, node) NOT IN (SELECT (source, target) FROM pins)
UNION ALL SELECT p.source, p.target, (x.cost + y.cost)::BIGINT, p.source || '-5-' || p.target, 'by hand' FROM pins p LEFT JOIN edges x ON x.src = p.source AND x.dst = 5 LEFT JOIN edges y ON y.src = 5 AND y.dst = p.target""")
def g6_pinned(spark: SparkSession, d: str) -> DataFrame:
    r, e = routes(spark, d)
    out = paths.apply_overrides(r.drop("hops").withColumn("hops", F.lit(0)), pinned(spark, d), e)
    return out.select("source", "target", F.col("cost").cast("long").alias("cost"), F.concat_ws("-", F.col("chain").cast("array<string>")).alias("chain"), F.coalesce("override_reason", F.lit("")).alias("reason"))


ALLOWED = {"BUILDING": ["1-URGENT", "2-HIGH"], "AUTOMOBILE": ["3-MEDIUM"], "MACHINERY": ["5-LOW", "1-URGENT", "3-MEDIUM"]}


@query("""SELECT o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '1-URGENT' END
 WHEN 'AUTOMOBILE' THEN '3-MEDIUM' WHEN 'MACHINERY' THEN CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') THEN o_orderpriority ELSE '5-LOW' END END AS mode
 FROM orders JOIN customer ON o_custkey = c_custkey""")
def g7_mode_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return o.select("o_orderkey", paths.effective_mode(F.col("o_orderpriority"), F.try_element_at(allowed, F.col("c_mktsegment"))).alias("mode"))


@query(PATHS + """, req AS (SELECT l_orderkey, l_linenumber, s_nationkey::BIGINT AS source, c_nationkey::BIGINT AS target, CASE l_returnflag WHEN 'R' THEN 'fancy' WHEN 'A' THEN 'editable' ELSE 'exact' END AS mode
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
j AS (SELECT req.*, CASE WHEN target % 2 = 0 AND mode = 'editable' THEN 'editable' ELSE 'exact' END AS effective, best.cost, best.hops FROM req LEFT JOIN best ON best.source = req.source AND best.node = req.target),
k AS (SELECT *, CASE WHEN mode = 'fancy' THEN 'unknown mode' WHEN source % 5 = 4 THEN 'not a source' WHEN target % 7 = 6 THEN 'not a target' WHEN source = target THEN 'same format' WHEN cost IS NULL OR effective = 'editable' THEN 'no route' END AS reject_reason FROM j)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, source, target, reject_reason, (CASE WHEN reject_reason IS NULL THEN cost END)::BIGINT AS cost, (CASE WHEN reject_reason IS NULL THEN hops END)::BIGINT AS hops FROM k""")
def g8_plan_requests(spark: SparkSession, d: str) -> DataFrame:
    r, _ = routes(spark, d)
    k = F.col("n_nationkey").cast("long")
    roles = F.array_compact(F.array(F.when(k % 5 != 4, "source"), F.when(k % 7 != 6, "target")))
    formats = table(spark, d, "nation").select(k.alias("format"), roles.alias("roles"), F.when(k % 2 == 0, F.array(F.lit("exact"), F.lit("editable"))).otherwise(F.array(F.lit("exact"))).alias("target_modes"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("source"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("target"))
    mode = F.when(F.col("l_returnflag") == "R", "fancy").when(F.col("l_returnflag") == "A", "editable").otherwise("exact")
    req = table(spark, d, "lineitem").join(s, "l_suppkey").join(o, "l_orderkey").join(c, "c_custkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "source", "target", mode.alias("mode"))
    out = paths.plan_requests(req, formats, r, ("exact", "editable"))
    return out.select("l_orderkey", "l_linenumber", "source", "target", "reject_reason", F.col("cost").cast("long").alias("cost"), F.col("hops").cast("long").alias("hops"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def caps(spark: SparkSession, d: str) -> DataFrame:
    seg = F.explode(F.array(*(F.struct(F.lit(s).alias("feature"), F.lit(i).alias("i")) for i, s in enumerate(SEGMENTS)))).alias("s")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("format"), seg)
    return n.select("format", "s.feature", ((F.col("format") * 7 + F.col("s.i") * 3 + F.floor(F.col("format") / 4)) % 3).cast("long").alias("level"))


CAPS = """, feats AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS feature, unnest([0, 1, 2, 3, 4]) AS i),
caps AS (SELECT n_nationkey::BIGINT AS format, feature, i, (n_nationkey * 7 + i * 3 + n_nationkey // 4) % 3 AS level FROM nation, feats),
ways AS (SELECT source, node AS target, unnest(chain[2:]) AS format FROM best),
kept AS (SELECT w.source, w.target, c.feature, c.i, min(c.level) AS keep FROM ways w JOIN caps c USING (format) GROUP BY ALL),
lost AS (SELECT k.source, k.target, k.feature, k.i, h.level AS have, k.keep, CASE WHEN k.keep = 0 THEN 'lost' ELSE 'reduced' END AS level FROM kept k JOIN caps h ON h.format = k.source AND h.feature = k.feature WHERE h.level > 0 AND k.keep < h.level)"""


@query(PATHS + CAPS + " SELECT source, target, feature, have::BIGINT AS have, keep::BIGINT AS keep, level FROM lost")
def g9_path_losses(spark: SparkSession, d: str) -> DataFrame:
    r, _ = routes(spark, d)
    return losses.path_losses(r, caps(spark, d)).drop("mode")


def edge_losses(e: DataFrame) -> DataFrame:
    o = F.col("edge_ord")
    return e.select("edge_ord", F.lit(0).alias("pos"), F.concat(F.lit("loss "), (o % 4).cast("string")).alias("text"), F.when(o % 3 == 0, "BUILDING").alias("if_source_has"))


STEPS = """, steps AS (SELECT source, node AS target, unnest(ords) AS ord, unnest(range(len(ords))) AS pos FROM best),
texts AS (SELECT s.source, s.target, 'loss ' || (ord % 4) AS text, min(pos) AS pos FROM steps s
 WHERE ord % 3 <> 0 OR EXISTS (SELECT 1 FROM caps c WHERE c.format = s.source AND c.feature = 'BUILDING' AND c.level > 0) GROUP BY ALL),
said AS (SELECT source, target, string_agg(text, '; ' ORDER BY pos) AS texts FROM texts GROUP BY ALL)"""


@query(PATHS + CAPS + STEPS + " SELECT source, target, texts FROM said")
def g10_step_losses(spark: SparkSession, d: str) -> DataFrame:
    r, e = routes(spark, d)
    return losses.step_losses(r, edge_losses(e), caps(spark, d)).select("source", "target", F.array_join("texts", "; ").alias("texts"))


@query(PATHS + CAPS + STEPS + """, folded AS (SELECT *, (target % 2 = 1 AND i < 2) AS fold FROM lost),
s AS (SELECT source, target, bool_or(fold) AS fold, string_agg(feature, ', ' ORDER BY i) FILTER (NOT fold AND level = 'lost') AS l, string_agg(feature, ', ' ORDER BY i) FILTER (NOT fold AND level = 'reduced') AS p FROM folded GROUP BY ALL)
SELECT b.source, b.node AS target, CASE WHEN x = '' THEN 'None expected' ELSE x END AS summary FROM (
 SELECT b.source, b.node, concat_ws('; ', CASE WHEN s.fold THEN 'Flattened to pixels' END, 'Lost: ' || s.l, 'Partial: ' || s.p, said.texts) AS x
 FROM best b LEFT JOIN s ON s.source = b.source AND s.target = b.node LEFT JOIN said ON said.source = b.source AND said.target = b.node) b""")
def g11_summary_text(spark: SparkSession, d: str) -> DataFrame:
    r, e = routes(spark, d)
    r, c = r.select("source", "target", "mode", "chain", "edge_ords"), caps(spark, d)
    formats = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("format"), (F.col("n_nationkey") % 2 == 1).alias("pixels"))
    features = spark.createDataFrame([(s, s, i < 2, i) for i, s in enumerate(SEGMENTS)], "feature string, label string, visual boolean, ord int")
    return losses.summarise_losses(r, losses.path_losses(r, c), losses.step_losses(r, edge_losses(e), c), formats, features).drop("mode")


@query("""SELECT s.r_name AS source, """ + ", ".join(f"CASE WHEN s.r_name = '{r}' THEN '·' ELSE nullif(sum(CASE WHEN c.r_name = '{r}' THEN 1 ELSE 0 END), 0)::VARCHAR END AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + """
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN region s ON a.n_regionkey = s.r_regionkey
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey JOIN region c ON b.n_regionkey = c.r_regionkey GROUP BY s.r_name""")
def g12_grid(spark: SparkSession, d: str) -> DataFrame:
    e = edges_by_region(spark, d)
    return reports.pivot_grid(e, "source", "target", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], F.sum("n").cast("string"), "·")


def with_engine(e: DataFrame) -> DataFrame:
    o = F.col("edge_ord")
    return e.withColumns({"edge_id": F.concat(F.lit("e"), o), "engine": F.when(o % 4 == 0, "an OCR engine").otherwise("press"), "summary": F.concat(F.lit("step "), o % 4)})


@query(PATHS + ", c AS (SELECT source, node, 'e' || len(ords) || CASE WHEN list_bool_or(list_transform(ords, lambda x: x % 4 = 0)) THEN '*' ELSE '' END || CASE WHEN (source + node) % 6 = 0 THEN '!' ELSE '' END AS cell FROM best) SELECT source, "
 + ", ".join(f"CASE WHEN source = {v} THEN '·' ELSE coalesce(max(CASE WHEN node = {v} THEN cell END), '') END AS \"{v}\"" for v in range(25)) + " FROM c GROUP BY source")
def g12_route_grid(spark: SparkSession, d: str) -> DataFrame:
    r, e = routes(spark, d)
    r = r.withColumn("override_reason", F.when((F.col("source") + F.col("target")) % 6 == 0, "by hand"))
    return reports.route_grid(r, with_engine(e), list(range(25)))


def edges_by_region(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("source"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("target"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    return line.join(s, "l_suppkey").groupBy("l_orderkey", "source").agg(F.count(F.lit(1)).alias("n")).join(o, "l_orderkey").select("source", "target", "n")


@query("""SELECT p_brand AS edge_id, count(DISTINCT p_brand || '>' || p_type) AS n_pairs, array_to_string(list_sort(list_distinct(list('exact:' || p_size))), ', ') AS modes, array_to_string(list_sort(list_distinct(list(p_type))), '; ') AS losses FROM part GROUP BY p_brand""")
def g13_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    e = p.select(F.col("p_brand").alias("edge_id"), F.col("p_partkey").alias("edge_ord"), F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("exact").alias("mode"), F.col("p_size").alias("cost"))
    return reports.edge_rollup(e, p.select(F.col("p_partkey").alias("edge_ord"), F.col("p_type").alias("text"))).drop("pairs")


@query("SELECT a.n_name AS source, b.n_name AS target, s AS mode FROM nation a JOIN nation b ON a.n_name <> b.n_name, (SELECT DISTINCT c_mktsegment AS s FROM customer)")
def g14_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    modes = table(spark, d, "customer").groupBy().agg(F.array_sort(F.collect_set("c_mktsegment")).alias("target_modes"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("format"), F.array(F.lit("source"), F.lit("target")).alias("roles"))
    return paths.all_requests(n.crossJoin(F.broadcast(modes)))  # one row


@query("SELECT event_type AS member, count(DISTINCT user_id) AS rows FROM events GROUP BY 1")
def g15_roles(spark: SparkSession, d: str) -> DataFrame:
    return catalog.membership(table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types")), "types")


@query("""WITH n AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k, o_custkey AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0),
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders)
SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM n FULL JOIN o ON n.k = o.k WHERE o.k IS NULL OR n.k IS NULL OR n.c IS DISTINCT FROM o.c OR n.s IS DISTINCT FROM o.s""")
def g16_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    new = o.where("k % 11 <> 0").select(F.when(F.col("k") % 13 == 0, F.col("k") + 100_000_000).otherwise(F.col("k")).alias("k"), "c", F.when(F.col("k") % 7 == 0, "Z").otherwise(F.col("s")).alias("s"))
    return reports.snapshot_diff(new, o, ["k"])


@query("""WITH n AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders),
a AS (SELECT k % 1000 AS k, s FROM n), b AS (SELECT o_orderkey % 1000 AS k, o_orderstatus AS s FROM orders)
SELECT *, 'new' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'old' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def g16_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows without a key that only one snapshot holds, repeats counted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = o.select(F.when(F.col("k") % 13 == 0, F.col("k") + 100_000_000).otherwise(F.col("k")).alias("k"), F.when(F.col("k") % 7 == 0, "Z").otherwise(F.col("s")).alias("s"))
    return reports.multiset_rows_diff(*(x.withColumn("k", F.col("k") % 1000) for x in (new, o)))


@query(PATHS + CAPS + STEPS + """, way AS (SELECT source, target, string_agg('{"pos":' || pos || ',"edge_id":"e' || ord || '","engine":"' || CASE WHEN ord % 4 = 0 THEN 'an OCR engine' ELSE 'press' END
  || '","src":' || ord // 1000 || ',"dst":' || ord % 1000 || ',"summary":"step ' || ord % 4 || '"}', ',' ORDER BY pos) AS j FROM steps GROUP BY ALL),
gone AS (SELECT source, target, string_agg('{"feature":"' || feature || '","level":"' || level || '"}', ',' ORDER BY feature) AS j FROM lost GROUP BY ALL),
tell AS (SELECT source, target, '"' || string_agg(text, '","' ORDER BY pos) || '"' AS j FROM texts GROUP BY ALL)
SELECT b.source, b.node AS target, '{"source":' || b.source || ',"target":' || b.node || ',"mode":"exact","chain":[' || array_to_string(b.chain, ',') || '],"cost":' || b.cost || ',"steps":[' || way.j || ']'
 || coalesce(',"potential_losses":[' || gone.j || ']', '') || coalesce(',"step_losses":[' || tell.j || ']', '') || '}' AS record
 FROM best b JOIN way ON way.source = b.source AND way.target = b.node LEFT JOIN gone ON gone.source = b.source AND gone.target = b.node LEFT JOIN tell ON tell.source = b.source AND tell.target = b.node""")
def g17_export_routes(spark: SparkSession, d: str) -> DataFrame:
    r, e = routes(spark, d)
    c = caps(spark, d)
    r = r.withColumn("cost", F.col("cost").cast("long"))
    return reports.export_routes(r, with_engine(e), losses.path_losses(r, c), losses.step_losses(r, edge_losses(e), c)).drop("mode")


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"' || coalesce(',"lines":[' || l || ']', '') || '}' AS record FROM orders LEFT JOIN (
 SELECT l_orderkey, string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def g17_nested_export(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    out = reports.nested(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), line, ["o_orderkey"], ["l_linenumber"], "lines")
    return out.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus", "lines")).alias("record"))


@query(PATHS + """ SELECT source, node AS target, (chain[1] = source AND chain[-1] = node) AS ends_right, len(list_distinct(chain)) = len(chain) AS no_revisit,
 len(chain) = 2 OR list_bool_and(list_transform(chain[2:-2], lambda x: x % 5 = 0)) AS inner_may_be_left, (source, node) NOT IN (SELECT (source, node) FROM best WHERE list_contains(chain[2:-2], 5)) AS forbidden_outside FROM best""")
def g18_path_invariants(spark: SparkSession, d: str) -> DataFrame:
    r, e = routes(spark, d)
    out = paths.path_invariants(r, e, nodes(spark, d), 5)
    return out.where("modes_valid and final_only_last").select("source", "target", "ends_right", "no_revisit", "inner_may_be_left", "forbidden_outside")
