"""Reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_grid(cells: DataFrame, row: str, column: str, values: list, cell: Column, diagonal: str | None = None) -> DataFrame:
    """One row for each `row`, one column for each of `values`; with diagonal, that text where both are equal.

    The values are given, so the pivot needs no extra job and its width is fixed.
    """
    out = cells.groupBy(row).pivot(column, values).agg(cell)
    if diagonal is not None:
        for v in values:
            name = str(v)
            out = out.withColumn(name, F.when(F.col(row) == F.lit(v), diagonal).otherwise(F.col(f"`{name}`")))
    return out


def route_grid(routes: DataFrame, edges: DataFrame, targets: list[str], flagged: str = "ocr") -> DataFrame:
    """source x target: for each mode its number of steps, marked * where an engine's name holds `flagged`
    and ! where the route is pinned; the diagonal is a dot."""
    steps = routes.select("source", "target", "mode", F.explode("edge_ords").alias("edge_ord"))
    marks = steps.join(edges.select("edge_ord", "engine").distinct(), "edge_ord").groupBy("source", "target", "mode").agg(
        F.bool_or(F.lower("engine").contains(flagged)).alias("flag"))
    cells = routes.join(marks, ["source", "target", "mode"], "left").select(
        "source", "target", "mode",
        F.concat(F.substring("mode", 1, 1), F.size("edge_ords").cast("string"), F.when(F.col("flag"), "*").otherwise(""), F.when(F.col("override_reason").isNotNull(), "!").otherwise("")).alias("cell"),
    )
    return pivot_grid(cells, "source", "target", targets, F.concat_ws(" ", F.array_sort(F.collect_list("cell"))), "·")


def edge_rollup(edges: DataFrame, edge_losses: DataFrame) -> DataFrame:
    """One row for each edge id: its pairs, its modes with cost, its losses sorted and once each."""
    pair = F.concat(F.col("src"), F.lit(">"), F.col("dst"))
    losses = edges.select("edge_id", "edge_ord").distinct().join(edge_losses, "edge_ord").groupBy("edge_id").agg(
        F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("losses"))
    own = edges.groupBy("edge_id").agg(
        F.array_join(F.expr("transform(array_sort(collect_set(struct(edge_ord, concat(src, '>', dst) as pair))), x -> x.pair)"), ", ").alias("pairs"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "mode", F.col("cost").cast("string")))), ", ").alias("modes"),
        F.count_distinct(pair).alias("n_pairs"),
    )
    return own.join(losses, "edge_id", "left").withColumn("losses", F.coalesce("losses", F.lit("")))


def snapshot_diff(new: DataFrame, old: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """keys and change (added, removed, changed) of the rows that differ; no rows: the snapshot is fresh.

    Rows under one key are compared as multisets, nulls equal nulls: equal rows cancel out, and of the rest as
    many as both sides have under the key are changed, the others added or removed. First the rows of both
    sides are digested by bucket of the keys (count, sum and xor of hashes); only buckets that differ are
    compared, so equal snapshots cost two scans and no shuffle of rows.
    """
    rest = sorted(c for c in new.columns if c not in keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    hashed = F.xxhash64(*keys, *rest)

    def digest(df: DataFrame, sign: int) -> DataFrame:
        own = df.select(bucket, hashed.alias("_h")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("s"), F.bit_xor("_h").alias("x"))
        return own.select("_bucket", (sign * F.col("n")).alias("n"), (sign * F.col("s")).alias("s"), "x")

    both = digest(new, 1).unionByName(digest(old, -1)).groupBy("_bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    differ = both.where("n <> 0 or s <> 0 or x <> 0").select("_bucket")  # `buckets` rows at most

    def side(df: DataFrame, sign: int) -> DataFrame:
        own = df.withColumn("_bucket", bucket).join(F.broadcast(differ), "_bucket", "left_semi")
        return own.select(*keys, F.struct(F.lit(0), *rest).alias("_row"), F.lit(sign).alias("_sign"))

    left = side(new, 1).unionByName(side(old, -1)).groupBy(*keys, "_row").agg(F.sum("_sign").alias("_left")).where("_left <> 0")
    sums = left.groupBy(*keys).agg(F.sum(F.greatest("_left", F.lit(0))).alias("_n"), F.sum(F.greatest(-F.col("_left"), F.lit(0))).alias("_o"))
    each = lambda change, n: F.array_repeat(F.lit(change), n.cast("int"))
    same = F.least("_n", "_o")
    changes = F.concat(each("changed", same), each("added", F.col("_n") - same), each("removed", F.col("_o") - same))
    return sums.select(*keys, F.explode(changes).alias("change"))


def multiset_rows_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Whole rows that only one side holds, repeats counted, with side (new, old)."""
    a = new.exceptAll(old).withColumn("side", F.lit("new"))
    return a.unionByName(old.exceptAll(new).withColumn("side", F.lit("old")))


def nested(parents: DataFrame, children: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """parents with their children as an ordered array of structs."""
    rest = [c for c in children.columns if c not in keys and c not in order]
    lists = children.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    return parents.join(lists, keys, "left")


def export_routes(routes: DataFrame, edges: DataFrame, losses: DataFrame, steps: DataFrame) -> DataFrame:
    """One JSON record for each route: chain, steps, potential losses, step losses."""
    k = ["source", "target", "mode"]
    way = routes.select(*k, F.posexplode("edge_ords").alias("pos", "edge_ord")).join(edges.select("edge_ord", "mode", "edge_id", "engine", "src", "dst", "summary"), ["edge_ord", "mode"])
    df = nested(routes, way.drop("edge_ord"), k, ["pos"], "steps")
    df = nested(df, losses.select(*k, "feature", "level"), k, ["feature"], "potential_losses").join(steps.withColumnRenamed("texts", "step_losses"), k, "left")
    return df.select(*k, F.to_json(F.struct("source", "target", "mode", "chain", "cost", "steps", "potential_losses", "step_losses")).alias("record"))


def export_reports(checks: DataFrame, labels: DataFrame, job: str = "job") -> DataFrame:
    """One JSON record for each job: its label and its checks in order."""
    return nested(labels, checks, [job], ["check"], "checks").select(job, F.to_json(F.struct(job, "label", "checks")).alias("record"))


def labelled_reports(checks: DataFrame, job: str, label: Column) -> DataFrame:
    """job, label and record of `export_reports`, where the label is an aggregate of the job's checks: checks
    are read and grouped once, and nothing is joined."""
    rest = [c for c in checks.columns if c not in (job, "check")]
    one = checks.groupBy(job).agg(label.alias("label"), F.array_sort(F.collect_list(F.struct("check", *rest))).alias("checks"))
    return one.select(job, "label", F.to_json(F.struct(job, "label", "checks")).alias("record"))


def results_rollup(results: DataFrame, dims: tuple[str, str], status: str, statuses: tuple[str, ...]) -> DataFrame:
    """Counts by status of every pair of dimensions, with subtotals and the total (level: 0 pair, 1 first
    dimension, 3 all)."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return results.rollup(*dims).agg(F.grouping_id().cast("int").alias("level"), *counts, F.count(F.lit(1)).alias("total"))


def against_threshold(results: DataFrame, expected: DataFrame, keys: list[str], value: str, limit: str) -> DataFrame:
    """Each result with its threshold and whether it reaches it; null where none is set."""
    return results.join(expected.select(*keys, limit), keys, "left").withColumn("reached", F.col(value) >= F.col(limit))
