"""Queries of the size and band operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sizing
from ..sources.files import table
from .registry import query


@query("""WITH s AS (SELECT DISTINCT p_size::BIGINT AS spec, CASE p_size % 3 WHEN 0 THEN 25.4::DOUBLE WHEN 1 THEN 2.54::DOUBLE ELSE 1.0::DOUBLE END AS per FROM part), j AS (SELECT spec, dpi, spec::DOUBLE / per * dpi AS exact FROM s, (VALUES (72), (150), (200), (300), (600)) AS t(dpi)),
e AS (SELECT spec, dpi, round(exact)::BIGINT AS px, round(abs(round(exact) - exact), 9) AS err FROM j)
SELECT spec, dpi::BIGINT AS dpi, px, dpi = first_value(dpi) OVER (PARTITION BY spec ORDER BY err, dpi) AS best FROM e""")
def m1_units(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("spec")).distinct()
    specs = p.select("spec", F.col("spec").cast("double").alias("size"), F.when(F.col("spec") % 3 == 0, "mm").when(F.col("spec") % 3 == 1, "cm").otherwise("in").alias("unit"))
    dpis = spark.createDataFrame([(x,) for x in (72, 150, 200, 300, 600)], "dpi long")
    return sizing.plan_sizes(specs, dpis).select("spec", "dpi", "px", "best")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber * 10000000 + l_partkey * 10 + l_suppkey % 10 AS id, l_quantity::BIGINT AS size, round(l_discount * 100)::BIGINT AS score FROM lineitem),
c AS (SELECT *, CASE WHEN size BETWEEN 20 AND 30 THEN 0 WHEN size > 30 THEN 1 ELSE 2 END AS tier FROM l)
SELECT k, id AS picked, size, CASE tier WHEN 0 THEN 'in band' WHEN 1 THEN 'smallest above' ELSE 'largest below' END AS reason FROM c
QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, CASE tier WHEN 0 THEN -score WHEN 1 THEN size ELSE -size END, id, size) = 1""")
def m2_pick_in_band(spark: SparkSession, d: str) -> DataFrame:
    """M2 by order, whose few lines make all three reasons occur."""
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("id"),
        F.col("l_quantity").cast("long").alias("size"), F.round(F.col("l_discount") * 100).cast("long").alias("score"),
    )
    return sizing.pick_in_band(line, ["k"], "id", "size", "score", 20, 30).drop("scale_to_fit")


@query("""WITH l AS (SELECT l_partkey AS k, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS id, l_quantity::BIGINT AS size, round(l_discount * 100)::BIGINT AS score FROM lineitem),
c AS (SELECT *, CASE WHEN size BETWEEN 20 AND 30 THEN 0 WHEN size > 30 THEN 1 ELSE 2 END AS tier FROM l)
SELECT k, id AS picked, size, CASE tier WHEN 0 THEN 'in band' WHEN 1 THEN 'smallest above' ELSE 'largest below' END AS reason FROM c
QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, CASE tier WHEN 0 THEN -score WHEN 1 THEN size ELSE -size END, id, size) = 1""")
def m2_pick_from_all(spark: SparkSession, d: str) -> DataFrame:
    """M2 by part, whose many lines nearly always hold one in the band."""
    line = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("id"),
        F.col("l_quantity").cast("long").alias("size"), F.round(F.col("l_discount") * 100).cast("long").alias("score"),
    )
    return sizing.pick_in_band(line, ["k"], "id", "size", "score", 20, 30).drop("scale_to_fit")


@query("SELECT c_custkey, 'own' AS c_mktsegment, false AS is_new FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment, true FROM customer WHERE c_custkey % 3 <> 0")
def m3_merge_defaults(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sizing.merge_defaults(c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("own")), c, "c_custkey")


@query("""SELECT l_orderkey, l_returnflag AS rule, l_quantity::BIGINT AS value, CASE WHEN l_quantity BETWEEN lo AND hi THEN 'green' WHEN l_quantity BETWEEN lo - slack AND hi + slack THEN 'amber' ELSE 'red' END AS band
FROM lineitem JOIN (VALUES ('A', 10, 40, 5), ('N', 5, 30, 10), ('R', 20, 25, 2)) AS s(rule, lo, hi, slack) ON rule = l_returnflag""")
def m4_bands(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([("A", 10, 40, 5), ("N", 5, 30, 10), ("R", 20, 25, 2)], "rule string, lo long, hi long, slack long")
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("rule"), F.col("l_quantity").cast("long").alias("value"))
    return sizing.check_bands(line, specs).select("l_orderkey", "rule", "value", "band")


@query("""WITH e AS (SELECT p_brand, p_partkey, unnest(range(1, p_size + 1)) AS copy FROM part), n AS (SELECT *, row_number() OVER (ORDER BY p_brand, p_partkey, copy) - 1 AS k FROM e)
SELECT p_partkey, copy, k // 20 AS sheet, k % 20 // 4 AS row, k % 4 AS col FROM n""")
def m5_place(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    out = sizing.place_on_grid(p, "p_brand", ["p_partkey"], "p_size", 5, 4)
    return out.select("p_partkey", *(F.col(c).cast("long").alias(c) for c in ("copy", "sheet", "row", "col")))


@query("""WITH s AS (SELECT p_size::BIGINT AS w, count(*) AS needed FROM part GROUP BY 1), p AS (SELECT DISTINCT p_size::BIGINT AS paper, p_size * 7 AS width, p_size * 10 AS height FROM part),
c AS (SELECT paper, w AS item, needed, greatest((width - 4 + 1) // (w + 1), 0) AS cols, greatest((height - 4 + 1) // (2 * w + 1), 0) AS rows FROM p, s)
SELECT paper, item, cols::BIGINT AS cols, rows::BIGINT AS rows, (CASE WHEN cols * rows > 0 THEN (needed + cols * rows - 1) // (cols * rows) END)::BIGINT AS sheets FROM c""")
def m6_capacity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("s"))
    sizes = p.groupBy("s").agg(F.count(F.lit(1)).alias("needed")).select(F.col("s").alias("item"), F.col("s").alias("w"), (F.col("s") * 2).alias("h"), "needed")
    papers = p.distinct().select(F.col("s").alias("paper"), (F.col("s") * 7).alias("width"), (F.col("s") * 10).alias("height"))
    return sizing.grid_capacity(papers, sizes, 2, 1).select("paper", "item", "cols", "rows", "sheets")
