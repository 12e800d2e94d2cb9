"""Job journals in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resume_steps(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned steps without a finished one."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def first_unfinished(plan: DataFrame, done: DataFrame, keys: list[str], batch: str, item: str, order: str) -> DataFrame:
    """batch, item: the first one in order with a step left."""
    return resume_steps(plan, done, keys).groupBy(batch).agg(F.min_by(item, F.struct(order, item)).alias(item))


def status_board(jobs: DataFrame, batch: str, status: str, statuses: list[str], done: list[str]) -> DataFrame:
    """batch, a count for each status, total, percent (of the done statuses) and badge."""
    out = jobs.groupBy(batch).pivot(status, statuses).agg(F.count(F.lit(1))).na.fill(0, statuses)
    total = jobs.groupBy(batch).agg(F.count(F.lit(1)).alias("total"))
    finished = sum((F.col(f"`{s}`") for s in done), F.lit(0))
    out = out.join(total, batch).withColumn("percent", F.floor(100 * finished / F.col("total")).cast("long"))
    return out.withColumn("badge", F.when(F.col("percent") == 100, "done").when(F.col("percent") == 0, "waiting").otherwise("running"))


def expired(jobs: DataFrame, status: str, finished: str, now, days: int = 7) -> DataFrame:
    """Jobs to drop: those that succeeded, and failed ones older than `days` days."""
    old = F.col(finished) < F.lit(now) - F.expr(f"interval {days} days")
    return jobs.where((F.col(status) == "success") | (F.col(status) == "failed") & old)


def assert_none(events: DataFrame, watch: DataFrame, key: str) -> DataFrame:
    """One row: violations (events of a watched key) and passes."""
    bad = events.join(watch.select(key).distinct(), key, "left_semi")
    return bad.agg(F.count(F.lit(1)).alias("violations")).withColumn("passes", F.col("violations") == 0)


def _changes(intervals: DataFrame, keys: list[str], start: str, end: str, weight: str) -> DataFrame:
    """keys, _t, _s, _top, _at: the net change at each instant, as the summary of a stretch of one instant."""
    ups = intervals.select(*keys, F.col(start).alias("_t"), F.col(weight).alias("_s"))
    downs = intervals.select(*keys, F.col(end).alias("_t"), (-F.col(weight)).alias("_s"))
    net = ups.unionByName(downs).groupBy(*keys, "_t").agg(F.sum("_s").alias("_s"))
    return net.select(*keys, "_t", "_s", F.col("_s").alias("_top"), F.col("_t").alias("_at"))


def _joined(parts: DataFrame, keys: list[str], stretch: Column) -> DataFrame:
    """Summaries (begin, sum, greatest prefix, its first time) of what falls into a longer stretch as one."""
    own = parts.withColumn("_b", stretch)
    before = W.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("_top", F.col("_top") + F.coalesce(F.sum("_s").over(before), F.lit(0)))
    first = F.min_by("_at", F.struct(-F.col("_top"), F.col("_at")))
    return own.groupBy(*keys, "_b").agg(F.min("_t").alias("_t"), F.sum("_s").alias("_s"), F.max("_top").alias("_top"), first.alias("_at")).drop("_b")


def _stretches(parts: DataFrame) -> list[Column]:
    """Hours and months of times, or blocks of numbers; other types are one stretch."""
    kind = dict(parts.dtypes)["_t"]
    if kind.startswith(("timestamp", "date")):
        return [F.date_trunc("hour", "_t"), F.date_trunc("month", "_t")]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return [F.floor(F.col("_t") / 4096), F.floor(F.col("_t") / 4096**2)]
    return []


def peak_load(intervals: DataFrame, keys: list[str], start: str, end: str, weight: str, limit: float | None = None) -> DataFrame:
    """keys, peak_at, peak: when the running load is highest (the first time) and how high; an interval
    holds its start and not its end. With limit, over tells whether it is passed.

    Summaries are joined by hour, by month and in the end by key, so a key with a third of all intervals is
    dealt out by hours and no task holds its whole history.
    """
    parts = _changes(intervals, keys, start, end, weight)
    for stretch in _stretches(parts):
        parts = _joined(parts, keys, stretch)
    out = _joined(parts, keys, F.lit(0)).select(*keys, F.col("_top").alias("peak"), F.col("_at").alias("peak_at"))
    return out.withColumn("over", F.col("peak") > limit) if limit is not None else out


def peak_load_overall(intervals: DataFrame, start: str, end: str, weight: str) -> DataFrame:
    """One row: peak_at, peak over all intervals (null if there are none), joined as in peak_load."""
    return peak_load(intervals, [], start, end, weight).agg(F.max("peak").alias("peak"), F.max("peak_at").alias("peak_at"))
