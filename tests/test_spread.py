"""Running sums, peaks and report files: brute force, repeated runs, odd rows."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from lakewright.functions.prefix import sum_before
from lakewright.operators import jobs, reshape, sizing
from lakewright.sources import files


def test_sums_before(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot"] * 5 + ["a", None]), i, rnd.choice([None, 1, 2, 5])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys, order, rank in ((["k"], ["i"], lambda r: r[1]), ([], ["k", "i"], lambda r: (r[0] or "", r[1]))):
            got = {r.i: r.s for r in sum_before(df, keys, order, F.col("v"), "s").collect()}
            want = {}
            for group in [[r for r in rows if r[0] == k] for k in ("hot", "a", None)] if keys else [rows]:
                total = 0
                for r in sorted(group, key=rank):
                    want[r[1]] = total
                    total += r[2] or 0
            assert got == want
        assert sum_before(df.where("false"), [], ["i"], F.col("v"), "s").isEmpty()
        blocks = {(r.k, r.block): r.rows for r in reshape.labelled_blocks(df, "k", "i", 50).collect()}
        n = sum(r[0] == "hot" for r in rows)
        assert [blocks["hot", b] for b in range(-(-n // 50))] == [min(50, n - 50 * b) for b in range(-(-n // 50))]
        placed = sizing.place_on_grid(df.na.fill(0, ["v"]), "k", ["i"], "v", 3, 4).collect()
        assert sorted(r.number for r in placed) == list(range(sum(r[2] or 0 for r in rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def peak(intervals):
    """(peak, its first time) by trying every instant."""
    loads = [(sum(w for a, b, w in intervals if a <= t) - sum(w for a, b, w in intervals if b <= t), t) for a, b, _ in intervals for t in (a, b)]
    top = max(x for x, _ in loads)
    return top, min(t for x, t in loads if x == top)


def test_peaks(spark):
    rnd = random.Random(8)
    base = dt.datetime(2024, 1, 30)
    rows = []
    for _ in range(300):
        a = base + dt.timedelta(minutes=rnd.randint(0, 6000))
        rows.append((rnd.choice(["hot", "hot", "b"]), a, a + dt.timedelta(minutes=rnd.randint(0, 900)), rnd.randint(1, 4)))
    df = spark.createDataFrame(rows, "k string, a timestamp, b timestamp, w int")
    got = {r.k: (r.peak, r.peak_at) for r in jobs.peak_load(df, ["k"], "a", "b", "w").collect()}
    assert got == {k: peak([r[1:] for r in rows if r[0] == k]) for k in ("hot", "b")}
    one = jobs.peak_load_overall(df, "a", "b", "w").first()
    assert (one.peak, one.peak_at) == peak([r[1:] for r in rows])
    assert jobs.peak_load_overall(df.where("false"), "a", "b", "w").first().peak is None
    numbers = [(rnd.randint(-9000, 9000), w) for w in range(1, 60)]
    n = spark.createDataFrame([("k", a, a + 5000, w) for a, w in numbers], "k string, a long, b long, w long")
    r = jobs.peak_load(n, ["k"], "a", "b", "w").first()
    assert (r.peak, r.peak_at) == peak([(a, a + 5000, w) for a, w in numbers])


def held(path):
    """Every data file with its time of change, and all lines by partition."""
    found, lines = {}, {}
    for folder, _, names in os.walk(path):
        for x in names:
            if x.startswith("part-") and files.LOG not in folder:
                f = os.path.join(folder, x)
                found[f] = os.stat(f).st_mtime_ns
                lines.setdefault(os.path.basename(folder), []).extend(open(f).read().splitlines())
    return found, {k: sorted(v) for k, v in lines.items()}


def test_record_files(spark, tmp_path):
    path = str(tmp_path / "out")
    mk = lambda x: spark.createDataFrame(x, "day string, record string")
    rows = [("a", '{"x":1}'), ("a", '{"x":2}'), ("b", '{"x":3}'), ("b", '{"x":3}'), (None, '{"x":4}'), ("b", None)]
    assert files.write_records(mk(rows), path, ["day"], "r1") == 3
    first, lines = held(path)
    assert lines == {"day=a": ['{"x":1}', '{"x":2}'], "day=b": ['{"x":3}', '{"x":3}'], "day=__HIVE_DEFAULT_PARTITION__": ['{"x":4}']}
    assert files.write_records(mk(rows[::-1]), path, ["day"], "r2") == 0
    assert held(path) == (first, lines)
    assert files.write_records(mk([("a", '{"x":9}')]), path, ["day"], "r3") == 1
    second, lines = held(path)
    assert lines["day=a"] == ['{"x":9}'] and {f: t for f, t in second.items() if "day=a" not in f} == {f: t for f, t in first.items() if "day=a" not in f}
    assert sorted((r.day or "", r.value) for r in spark.read.text(path).collect()) == [("", '{"x":4}'), ("a", '{"x":9}'), ("b", '{"x":3}'), ("b", '{"x":3}')]
    # a run that died between its two entries: its partition is done again, though the one before was the same
    last = spark.read.json(f"{path}/{files.LOG}").where("day = 'a' and done").orderBy(F.desc("number")).limit(1)
    entry = last.withColumns({"number": F.col("number") + 1, "done": F.lit(False), "run": F.lit("dead")}).collect()
    spark.createDataFrame(entry, last.schema).write.mode("append").json(f"{path}/{files.LOG}")
    assert files.write_records(mk([("a", '{"x":9}')]), path, ["day"], "r4") == 1
    assert held(path)[1] == lines
    assert files.write_records(mk([]), path, ["day"], "r5") == 0 and files.write_records(mk([]), str(tmp_path / "none"), ["day"], "r") == 0


def test_product_with_and_without_broadcast(spark):
    left = spark.createDataFrame([(i % 7, None if i % 3 else "x") for i in range(50)], "k long, v string")
    right = spark.createDataFrame([(i % 5, float(i)) for i in range(40)], "r long, w double")
    want = sorted((a.k, a.v or "", b.r, b.w) for a in left.collect() for b in right.collect())
    for most in (1000, 40, 39, 3, 1):
        made = sizing.product(left, right, most)
        assert made.columns == ["k", "v", "r", "w"]
        assert sorted((r.k, r.v or "", r.r, r.w) for r in made.collect()) == want
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert ("NestedLoop" in plan) == (most >= 40) and "Cartesian" not in plan
    for a, b in ((left.where("false"), right), (left, right.where("false"))):
        assert sizing.product(a, b).isEmpty() and sizing.product(a, b, 0).isEmpty()
    papers = spark.createDataFrame([(i, 100 + i, 200.0) for i in range(20)], "paper long, width long, height double")
    sizes = spark.createDataFrame([(i, 10.0 + i, 9.0, 5) for i in range(20)], "item long, w double, h double, needed long")
    one, two = (sorted(map(tuple, sizing.grid_capacity(papers, sizes, 1, 2, most).collect())) for most in (100, 4))
    assert one == two and len(one) == 400
