"""Queries of the comparison operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..functions.text import edit_distance
from ..operators import compare, reports
from ..sources.files import table, write_records
from .registry import query

SPACE = r"[ \t\r\n\f\x0B]"


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '(\p{{L}})-[ \t]*\r?\n[ \t]*(\p{{Ll}})', '\1\2', 'g'), '{SPACE}+', ' ', 'g')) AS text,
 contains(text, chr(173)) AS soft_hyphen, regexp_matches(text, '\p{{L}}-[ \t]*\r?\n[ \t]*\p{{Ll}}') AS line_hyphen FROM documents""")
def v1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return compare.normalise_corpus(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "text", "soft_hyphen", "line_hyphen")


TOKENS = r"""toks AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents),
tokens AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM toks)"""


@query(f"WITH {TOKENS} SELECT doc_id, pos, token FROM tokens")
def v2_tokens(spark: SparkSession, d: str) -> DataFrame:
    return compare.tokens(table(spark, d, "documents"), "doc_id", "text").withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {TOKENS}, a AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL), b AS (SELECT doc_id - 1 AS doc_id, token, count(*) AS n FROM tokens GROUP BY ALL)
SELECT doc_id, token, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra FROM a FULL JOIN b USING (doc_id, token) WHERE a.n IS DISTINCT FROM b.n""")
def v3_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return compare.texts_diff(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", "text")


@query(f"""WITH {TOKENS}, a AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL), b AS (SELECT doc_id - 1 AS doc_id, token, count(*) AS n FROM tokens GROUP BY ALL),
diff AS (SELECT doc_id, token, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra FROM a FULL JOIN b USING (doc_id, token) WHERE a.n IS DISTINCT FROM b.n),
around AS (SELECT doc_id, pos, token, concat_ws(' ', lag(token, 2) OVER w, lag(token) OVER w, token, lead(token) OVER w, lead(token, 2) OVER w) AS context FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, token, pos, context, missing, extra FROM around JOIN diff USING (doc_id, token)""")
def v3_context(spark: SparkSession, d: str) -> DataFrame:
    """The places of differing tokens, with two tokens on either side."""
    docs = table(spark, d, "documents")
    return compare.texts_diff(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", "text", context=2)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each document's tokens beside those of the next doc_id."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"))  # smaller than the tokens on the way to the join
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return both.select("doc_id", *(F.filter(F.split(c, r"\s+"), lambda x: x != "").alias(c) for c in "ab"))


@query(f"""WITH {TOKENS}, w AS (SELECT x.doc_id, x.t AS a, y.t AS b FROM toks x JOIN toks y ON y.doc_id = x.doc_id + 1),
s AS (SELECT *, unnest(range(0, greatest(len(a), len(b), 1), 40)) AS k FROM w), p AS (SELECT doc_id, k, a[k + 1:k + 40] AS a, b[k + 1:k + 40] AS b FROM s), q AS (SELECT *, list_distinct(list_concat(a, b)) AS e FROM p)
SELECT doc_id, sum(levenshtein(array_to_string(list_transform(a, lambda x: chr((32 + list_position(e, x))::INT)), ''), array_to_string(list_transform(b, lambda x: chr((32 + list_position(e, x))::INT)), '')))::BIGINT AS distance,
 sum(greatest(len(a), len(b)))::BIGINT AS longest FROM q GROUP BY doc_id""")
def v4_slice_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances of slices of 40 tokens at the same place, summed: more than V4's wherever a token is inserted."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("a"), F.size("b"), F.lit(1)) - 1, F.lit(40))).alias("at")
    pieces = neighbours(spark, d).select("doc_id", start, "a", "b").select("doc_id", F.expr("slice(a, at + 1, 40)").alias("a"), F.expr("slice(b, at + 1, 40)").alias("b"))
    out = pieces.withColumn("distance", edit_distance("a", "b"))
    return out.groupBy("doc_id").agg(F.sum("distance").cast("long").alias("distance"), F.sum(F.greatest(F.size("a"), F.size("b"))).cast("long").alias("longest"))


@query()
def v4_token_similarity(spark: SparkSession, d: str) -> DataFrame:
    """V4 of whole documents, aligned at their anchors; tests hold it against the distance of all tokens."""
    out = compare.aligned_similarity(neighbours(spark, d), "a", "b")
    return out.select("doc_id", F.col("distance").cast("long").alias("distance"), F.greatest(F.size("a"), F.size("b")).cast("long").alias("longest"), "similarity")


@query()
def v4_whole_similarity(spark: SparkSession, d: str) -> DataFrame:
    """V4 over every token of both documents at once; no SQL, as DuckDB's distance is over bytes."""
    out = compare.token_similarity(neighbours(spark, d), "a", "b")
    return out.select("doc_id", F.col("distance").cast("long").alias("distance"), F.greatest(F.size("a"), F.size("b")).cast("long").alias("longest"), "similarity")


@query(f"""WITH RECURSIVE {TOKENS}, w AS (SELECT x.doc_id, x.t AS a, y.t AS b FROM toks x JOIN toks y ON y.doc_id = x.doc_id + 1),
ta AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM w), tb AS (SELECT doc_id, t, list(j ORDER BY j) AS js FROM (SELECT doc_id, unnest(b) AS t, generate_subscripts(b, 1) AS j FROM w) GROUP BY doc_id, t),
m AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS step, js FROM ta JOIN tb USING (doc_id, t)),
r AS (SELECT doc_id, 0::BIGINT AS step, [0::BIGINT] AS ends FROM w
 UNION ALL SELECT r.doc_id, m.step, list_filter(list_transform(list_append(ends, NULL), lambda e, k: CASE WHEN k = 1 THEN 0 ELSE least(e, list_min(list_filter(js, lambda j: j > ends[k - 1]))) END), lambda e: e IS NOT NULL)
 FROM r JOIN m ON m.doc_id = r.doc_id AND m.step = r.step + 1),
l AS (SELECT doc_id, max(len(ends)) - 1 AS lcs FROM r GROUP BY doc_id)
SELECT doc_id, lcs::BIGINT AS lcs, CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0::DOUBLE ELSE lcs::DOUBLE / greatest(len(a), len(b)) END AS order_score FROM l JOIN w USING (doc_id)""")
def v5_order_score(spark: SparkSession, d: str) -> DataFrame:
    """V5 of neighbours. The SQL keeps, for each length, the least place where a common subsequence of it ends."""
    return compare.order_score(neighbours(spark, d), "a", "b").select("doc_id", "lcs", "order_score")


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY ALL)
SELECT l_orderkey, l_returnflag, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(b.n, 0) = coalesce(a.n, 0) AS equal FROM a FULL JOIN b USING (l_orderkey, l_returnflag)""")
def v6_counts(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return compare.compare_counts(line, line.where("l_partkey % 10 <> 0"), ["l_orderkey"], "l_returnflag")


def altered(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 11 <> 0").select(
        F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )


ALTERED = """b AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c,
 CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0), a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders)"""


@query(f"""WITH {ALTERED}, j AS (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'differs' END AS status,
 CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c IS DISTINCT FROM b.c THEN 'o_custkey' END, CASE WHEN a.s IS DISTINCT FROM b.s THEN 'o_orderstatus' END) END AS columns, a.k IS NULL OR b.k IS NULL AS lone
 FROM a FULL JOIN b ON a.k = b.k) SELECT o_orderkey, status, columns FROM j WHERE lone OR columns <> ''""")
def v7_cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return compare.compare_cells(o, altered(o), ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages), b AS (SELECT DISTINCT page_id, CASE WHEN url LIKE '/t%' THEN url || '/' ELSE url END AS url FROM l)
SELECT page_id, url, CASE WHEN b.o IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT *, 1 AS o FROM l) a FULL JOIN (SELECT *, 1 AS o FROM b) b USING (page_id, url) WHERE a.o IS NULL OR b.o IS NULL""")
def v8_sets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("url"))
    return compare.compare_sets(a, a.withColumn("url", F.when(F.col("url").startswith("/t"), F.concat("url", F.lit("/"))).otherwise(F.col("url"))), ["page_id"], "url")


@query("""WITH p AS (SELECT p_partkey AS k, p_type AS asked, p_brand FROM part), c AS (SELECT DISTINCT a.p_type AS asked, b.p_type AS present FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7 AND a.p_brand = b.p_brand)
SELECT p.k, p.asked, q.asked AS present, CASE WHEN q.asked IS NULL THEN 'absent' WHEN p.asked = q.asked THEN 'same' WHEN (p.asked, q.asked) IN (SELECT (asked, present) FROM c) THEN 'compatible' ELSE 'different' END AS class
FROM p LEFT JOIN p q ON q.k = p.k + 1""")
def v9_substitution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    asked = p.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("asked"))
    present = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_type").alias("present"))
    mate = p.select((F.col("p_partkey") - 7).alias("p_partkey"), "p_brand", F.col("p_type").alias("present"))
    compat = p.join(mate, ["p_partkey", "p_brand"]).select(F.col("p_type").alias("asked"), "present")
    return compare.classify_substitution(asked, present, compat, ["k"])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, round(l_discount * 100)::BIGINT AS c FROM lineitem)
SELECT l_orderkey, bool_and(c >= 2) AS passes, min(c) AS least, arg_min(l_linenumber, c * 1000 + l_linenumber)::BIGINT AS worst FROM l GROUP BY 1""")
def v10_all_at_least(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.round(F.col("l_discount") * 100).cast("long").alias("c"))
    return compare.all_at_least(line, ["l_orderkey"], "line", "c", 2)


#: Orders of a task.
SHARE = 50_000


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Orders are dealt out once, SHARE to a task: keys in a row compress so well that Spark, which goes by
    compressed sizes, would give a task as many as there are."""
    o = table(spark, d, "orders")
    n = max(1, -(-o.count() // SHARE))
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus").repartition(n, "o_orderkey")
    b = altered(o).select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).repartition(n, "o_orderkey")
    j = o.join(b, "o_orderkey")
    ok = F.explode(F.create_map(F.lit("customer"), F.col("o_custkey") == F.col("c"), F.lit("status"), F.col("o_orderstatus") == F.col("s"))).alias("check", "ok")
    checks = j.select("o_orderkey", ok)
    expected = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("status").alias("check"))
    return compare.classify_checks(checks, expected, ["o_orderkey"])


OUTCOMES = f"""WITH {ALTERED}, ck AS (SELECT a.k, 'customer' AS "check", a.c = b.c AS ok FROM a JOIN b ON a.k = b.k UNION ALL SELECT a.k, 'status', a.s = b.s FROM a JOIN b ON a.k = b.k),
oc AS (SELECT k AS o_orderkey, "check", ok, CASE WHEN ok THEN 'pass' WHEN "check" = 'status' AND k % 3 = 0 THEN 'expected' ELSE 'fail' END AS outcome FROM ck),
lb AS (SELECT o_orderkey, CASE WHEN bool_or(outcome = 'fail') THEN 'Needs review' WHEN bool_and(outcome = 'pass') THEN 'Perfect' ELSE 'Converted with expected changes' END AS label FROM oc GROUP BY 1)"""


@query(OUTCOMES + ' SELECT o_orderkey, "check", ok, outcome FROM oc')
def v11_outcome(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d)


@query(OUTCOMES + " SELECT o_orderkey, label FROM lb")
def v12_label(spark: SparkSession, d: str) -> DataFrame:
    return compare.label_jobs(outcomes(spark, d), ["o_orderkey"])


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, sha256(a.text) AS hash_a, sha256(b.text) AS hash_b, CASE WHEN b.text IS NULL THEN 'missing' WHEN a.text = b.text THEN 'same' ELSE 're-encoded' END AS status FROM documents a LEFT JOIN b USING (doc_id)""")
def v13_hash_match(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", "text")
    b = a.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return compare.match_by_hash(a, b, ["doc_id"], "text")


REPORTS = (OUTCOMES + """ SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"label":"' || label || '","checks":[' || string_agg('{"check":"' || "check" || '","ok":' || ok || ',"outcome":"' || outcome || '"}', ',' ORDER BY "check") || ']}' AS record
FROM oc JOIN lb USING (o_orderkey) GROUP BY o_orderkey, label""")


@query(REPORTS)
def v14_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.labelled_reports(outcomes(spark, d), "o_orderkey", compare.job_label()).drop("label")


@query(f"SELECT r.o_orderkey, s.label, r.record FROM ({REPORTS}) r JOIN ({OUTCOMES} SELECT o_orderkey, label FROM lb) s USING (o_orderkey)")
def v14_report_files(spark: SparkSession, d: str) -> DataFrame:
    """The reports written as JSON lines under their label, and read again."""
    own = reports.labelled_reports(outcomes(spark, d), "o_orderkey", compare.job_label())
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    write_records(own, path, ["label"], "report")
    record = F.col("value")
    return spark.read.schema("value string, label string").text(path).select(F.get_json_object(record, "$.o_orderkey").cast("long").alias("o_orderkey"), "label", record.alias("record"))
