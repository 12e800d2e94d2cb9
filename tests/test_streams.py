"""Streams against the same rows in batch."""

import datetime as dt

from pyspark.sql import functions as F

from lakewright.streaming import progress


def source(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    e.repartition(1).sortWithinPartitions("ts").write.parquet(path)
    return e, spark.readStream.schema(e.schema).parquet(path)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_windows_sessions_latest_dedup(spark, data, tmp_path):
    batch, stream = source(spark, data, tmp_path)
    key = lambda df: {tuple(r) for r in df.collect()}
    closed = key(run(progress.log_rollup(stream, "ts", "1 day", ["event_type"], late="1 hour", level="event_type"), "w", "append"))
    assert closed and closed <= key(progress.log_rollup(batch, "ts", "1 day", ["event_type"], level="event_type"))
    closed = key(run(progress.sessions(stream, "user_id", "ts", "30 minutes", late="1 hour"), "s", "append"))
    every = key(progress.sessions(batch, "user_id", "ts", "30 minutes"))
    assert closed <= every and len(closed) >= len(every) - batch.select("user_id").distinct().count()
    last = key(run(progress.latest_progress(stream, "user_id", "ts", ["event_id"]), "l", "complete"))
    assert last == key(progress.latest_progress(batch, "user_id", "ts", ["event_id"]))
    twice = stream.unionByName(stream)
    assert run(progress.dedup_events(twice, ["event_id"], "ts", "1 hour"), "d", "append").count() == batch.count()


def test_silent_alarms(spark, data, tmp_path):
    batch, stream = source(spark, data, tmp_path)
    got = {r.user_id: r.silent_since for r in run(progress.silent_alarms(stream, "user_id", "ts"), "a", "append").collect()}
    last = {r.user_id: r.ts for r in batch.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert got and all(abs(got[u] - last[u]) < dt.timedelta(milliseconds=2) for u in got)
    assert len(got) >= len(last) - 1


def test_log(spark):
    lines = spark.createDataFrame([('{"level":"info","path":"/x"}',), ("broken",)], "v string")
    got = progress.hashed_paths(progress.parse_log(lines, "v", "level string, path string"), "path").collect()
    assert got[0].level == "info" and len(got[0].path) == 64 and got[1].level is None
    beats = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 50)], "job int, ts timestamp")
    gap = progress.heartbeat_gaps(beats, "job", "ts", "30 seconds").collect()
    assert [(g.gap_start.second, g.gap_end.second) for g in gap] == [(10, 50)]
