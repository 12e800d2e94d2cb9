"""Queries of the journal, progress and event operators; events are the job log, a user is a job."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs, reports
from ..sources.files import table
from ..streaming import progress
from .registry import query

TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time as a TIMESTAMP."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events), q AS (SELECT a.user_id, b.event_type FROM (SELECT DISTINCT user_id FROM p) a, (SELECT DISTINCT event_type FROM p) b)
SELECT user_id, event_type FROM q WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 100)""")
def j1_resume(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    plan = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, TYPES))).alias("event_type"))
    return jobs.resume_steps(plan, e.where("value > 100"), ["user_id", "event_type"])


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events), q AS (SELECT a.user_id, b.event_type FROM (SELECT DISTINCT user_id FROM p) a, (SELECT DISTINCT event_type FROM p) b)
SELECT user_id % 10 AS batch, arg_min(user_id, (event_type, user_id)) AS user_id FROM q WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 100) GROUP BY 1""")
def j1_first(spark: SparkSession, d: str) -> DataFrame:
    """The first user of each batch with a step left, steps in the order of their names."""
    e = table(spark, d, "events")
    plan = e.select("user_id", (F.col("user_id") % 10).alias("batch")).distinct().select("batch", "user_id", F.explode(F.array(*map(F.lit, TYPES))).alias("event_type"))
    return jobs.first_unfinished(plan, e.where("value > 100"), ["user_id", "event_type"], "batch", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_type, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def j2_latest(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest_progress(table(spark, d, "events"), "user_id", "ts", ["event_type", "event_id"]).select("user_id", "event_id", "ts")


@query("WITH e AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap_start, ts AS gap_end FROM events) SELECT * FROM e WHERE gap_end - gap_start > INTERVAL 12 HOUR")
def j3_gaps(spark: SparkSession, d: str) -> DataFrame:
    return progress.heartbeat_gaps(table(spark, d, "events"), "user_id", "ts", "12 hours")


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR, false) AS goes_on FROM events), s AS (SELECT user_id, ts, count_if(NOT goes_on) OVER (PARTITION BY user_id ORDER BY ts, goes_on ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def j3_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = progress.sessions(events(spark, d), "user_id", "ts", "12 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""WITH b AS (SELECT user_id % 10 AS batch, """ + ", ".join(f"count_if(event_type = '{t}') AS \"{t}\"" for t in TYPES) + """, count(*) AS total FROM events GROUP BY 1)
SELECT *, 100 * (purchase + signup) // total AS percent, CASE 100 * (purchase + signup) // total WHEN 100 THEN 'done' WHEN 0 THEN 'waiting' ELSE 'running' END AS badge FROM b""")
def j4_board(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("batch", F.col("user_id") % 10)
    return jobs.status_board(e, "batch", "event_type", TYPES, ["purchase", "signup"])


@query("SELECT event_type, user_id % 3 AS module, date_trunc('day', ts) AS start, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL")
def j5_windows(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("module", F.col("user_id") % 3)
    out = progress.log_rollup(e, "ts", "1 day", ["event_type", "module"], levels=["error", "view"], level="event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events WHERE event_type <> 'view' AND (event_type <> 'error' OR ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY)")
def j6_expired(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("success")
    e = events(spark, d).withColumn("status", status)
    return jobs.expired(e, "status", "ts", datetime.datetime(2024, 1, 30, tzinfo=datetime.UTC)).select("event_id", "status")


@query("SELECT count(*) AS violations, count(*) = 0 AS passes FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE value > 300)")
def j7_assert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return jobs.assert_none(e.where("event_type = 'error'"), e.where("value > 300"), "user_id")


@query("""WITH i AS (SELECT o_custkey AS k, o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate), e AS (SELECT k, a AS t, 1 AS w FROM i UNION ALL SELECT k, b, -1 FROM i),
n AS (SELECT k, t, sum(w) AS w FROM e GROUP BY ALL), l AS (SELECT k, t, sum(w) OVER (PARTITION BY k ORDER BY t) AS load FROM n)
SELECT k, max(load)::BIGINT AS peak, arg_min(t, (-load, t)) AS peak_at, max(load) > 3 AS over FROM l GROUP BY k""")
def j8_peak(spark: SparkSession, d: str) -> DataFrame:
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("b"))
    i = table(spark, d, "orders").join(ship, "o_orderkey").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("a"), "b", F.lit(1).alias("w"))
    return jobs.peak_load(i, ["k"], "a", "b", "w", 3)


@query("""WITH i AS (SELECT o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate), e AS (SELECT a AS t, 1 AS w FROM i UNION ALL SELECT b, -1 FROM i),
n AS (SELECT t, sum(w) AS w FROM e GROUP BY ALL), l AS (SELECT t, sum(w) OVER (ORDER BY t) AS load FROM n)
SELECT max(load)::BIGINT AS peak, arg_min(t, (-load, t)) AS peak_at FROM l""")
def j8_overall(spark: SparkSession, d: str) -> DataFrame:
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("b"))
    i = table(spark, d, "orders").join(ship, "o_orderkey").select(F.col("o_orderdate").alias("a"), "b", F.lit(1).alias("w"))
    return jobs.peak_load_overall(i, "a", "b", "w").withColumn("peak_at", F.col("peak_at").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity, p_size, l_quantity >= p_size AS reached FROM lineitem LEFT JOIN (SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size <= 40) ON p_partkey = l_partkey")
def j9_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Each line's quantity against its part's size; the largest parts set no threshold."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity")
    limits = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("p_size"))
    return reports.against_threshold(line, limits, ["l_partkey"], "l_quantity", "p_size")


@query("""SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count_if(l_quantity BETWEEN 10 AND 40) AS pass, count_if(l_quantity < 10) AS fail, count_if(l_quantity > 40) AS not_run, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def j9_rollup(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    line = table(spark, d, "lineitem").withColumn("status", F.when(q < 10, "fail").when(q > 40, "not_run").otherwise("pass"))
    return reports.results_rollup(line, ("l_returnflag", "l_linestatus"), "status", ("pass", "fail", "not_run")).withColumn("level", F.col("level").cast("long"))


@query("SELECT event_id, user_id, event_type FROM events")
def j10_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return progress.dedup_events(e.unionByName(e.where("user_id % 2 = 0")), ["event_id"])
