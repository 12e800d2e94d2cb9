"""Progress and log streams. Each function takes a batch or a streaming DataFrame, with
event time as TIMESTAMP."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def latest_progress(events: DataFrame, job: str, ts: str, cols: list[str]) -> DataFrame:
    """job, ts and cols of the last message; ties go to the larger columns. Streams: update mode."""
    last = F.max(F.struct(ts, *cols)).alias("_m")
    return events.groupBy(job).agg(last).select(job, "_m.*")


def heartbeat_gaps(events: DataFrame, key: str, ts: str, limit: str) -> DataFrame:
    """Batch: key, gap_start, gap_end where more than `limit` (an interval, as '30 seconds') passes between messages."""
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts))
    g = events.select(key, before.alias("gap_start"), F.col(ts).alias("gap_end"))
    return g.where(F.col("gap_end") - F.col("gap_start") > F.expr(f"interval {limit}"))


def sessions(events: DataFrame, key: str, ts: str, limit: str, late: str | None = None) -> DataFrame:
    """key, start, end, n: runs of messages not more than `limit` apart. With late (a stream), the watermark;
    append mode emits closed sessions."""
    src = events.withWatermark(ts, late) if late else events
    out = src.groupBy(key, F.session_window(ts, limit).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Silence(StatefulProcessor):
    """Keeps a key's last message and fires when event time passes it by the limit."""

    def __init__(self, limit_ms: int, key: str, ts: str):
        self.limit, self.key_name, self.ts = limit_ms, key, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max((int(pdf[self.ts].max().timestamp() * 1000) for pdf in rows), default=0)
        old = self.last.get()[0] if self.last.exists() else 0
        if newest > old:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.limit)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({self.key_name: [key[0]], "silent_since": [pd.Timestamp(since, unit="ms")]})

    def close(self) -> None:
        pass


def silent_alarms(events: DataFrame, key: str, ts: str, limit_seconds: int = 30, late: str = "10 seconds") -> DataFrame:
    """Stream: key, silent_since as soon as the watermark passes a key's last message by the limit. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    kind = dict(events.dtypes)[key]
    return (
        events.select(key, ts).withWatermark(ts, late).groupBy(key)
        .transformWithStateInPandas(
            _Silence(limit_seconds * 1000, key, ts), f"{key} {kind}, silent_since timestamp", outputMode="append", timeMode="EventTime"
        )
    )


def parse_log(lines: DataFrame, value: str, schema: str) -> DataFrame:
    """JSON lines as columns; a line that doesn't parse gives nulls."""
    return lines.select(F.from_json(value, schema).alias("_e")).select("_e.*")


def log_rollup(events: DataFrame, ts: str, window: str, keys: list[str], late: str | None = None, levels: list[str] | None = None, level: str = "level") -> DataFrame:
    """keys, start, n: messages by tumbling window; levels keeps some. With late (a stream), the watermark."""
    src = events.where(F.col(level).isin(*levels)) if levels else events
    src = src.withWatermark(ts, late) if late else src
    out = src.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def hashed_paths(events: DataFrame, path: str) -> DataFrame:
    """events with the path's sha256 in its place."""
    return events.withColumn(path, F.sha2(path, 256))


def dedup_events(events: DataFrame, ids: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """One row for each id; a stream keeps ids as long as the watermark allows late copies."""
    if late:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)
    return events.dropDuplicates(ids)
