"""M1-M6: sizes, bands, defaults and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import sum_before

#: Units in an inch.
PER_INCH = {"in": 1.0, "cm": 2.54, "mm": 25.4}


def inches(size: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, n in PER_INCH.items():
        out = F.when(unit == u, size / n).otherwise(out)
    return out


def product(left: DataFrame, right: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Every row of left beside every row of right. A right side of up to `most_rows` rows is broadcast; a larger
    one is dealt into blocks of half as many on average, each row of left is repeated for each block, and both
    are joined by the block and a part of left, so a task holds a block of right at a time. Blocks and parts go by
    the rows' own values, so a task that is run again deals them out alike; equal rows share a block."""
    n = right.limit(most_rows + 1).count()
    if n <= most_rows:
        return left.crossJoin(F.broadcast(right))
    blocks = -(-right.count() * 2 // max(1, most_rows))
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int"))
    every = every.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return every.join(dealt, ["_block", "_part"]).drop("_block", "_part")


def plan_sizes(specs: DataFrame, dpis: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """specs (spec, size, unit) in every DPI: px (rounded once), error in px and in mm, and best: the DPI of
    least error, the smallest among equals. DPIs are broadcast up to `most_rows` rows."""
    j = product(specs, dpis.select("dpi"), most_rows)
    exact = inches(F.col("size"), F.col("unit")) * F.col("dpi")
    j = j.withColumn("px", F.round(exact).cast("long")).withColumn("error_px", F.col("px") - exact).withColumn("error_mm", F.col("error_px") / F.col("dpi") * 25.4)
    best = j.groupBy("spec").agg(F.min_by("dpi", F.struct(F.round(F.abs("error_px"), 9), F.col("dpi"))).alias("best_dpi"))
    return j.join(best, "spec").withColumn("best", F.col("dpi") == F.col("best_dpi")).drop("best_dpi")


def pick_in_band(cands: DataFrame, keys: list[str], id: str, size: str, score: str, lo: float, hi: float) -> DataFrame:
    """keys, picked (id), size, reason and scale_to_fit: the best score within [lo, hi], else the smallest
    above, else the largest below; one aggregation. Ties go to the smaller id."""
    s, inside, above = F.col(size), F.col(size).between(lo, hi), F.col(size) > hi
    row = F.struct(F.col(id).alias("id"), s.alias("size"))
    out = cands.groupBy(*keys).agg(
        F.min_by(F.when(inside, row), F.when(inside, F.struct(-F.col(score), F.col(id)))).alias("a"),
        F.min_by(F.when(above, row), F.when(above, F.struct(s, F.col(id)))).alias("b"),
        F.min_by(F.when(s < lo, row), F.when(s < lo, F.struct(-s, F.col(id)))).alias("c"),
    )
    pick = F.coalesce("a", "b", "c")
    reason = F.when(F.col("a").isNotNull(), "in band").when(F.col("b").isNotNull(), "smallest above").when(F.col("c").isNotNull(), "largest below").otherwise("none")
    scale = F.when(reason == "smallest above", hi / pick["size"]).when(reason == "largest below", lo / pick["size"])
    return out.select(*keys, pick["id"].alias("picked"), pick["size"].alias("size"), reason.alias("reason"), scale.alias("scale_to_fit"))


def merge_defaults(user: DataFrame, shipped: DataFrame, id: str) -> DataFrame:
    """User rows as they are; shipped rows whose id the user lacks, marked new."""
    fresh = shipped.join(user.select(id), id, "left_anti").withColumn("is_new", F.lit(True))
    return user.withColumn("is_new", F.lit(False)).unionByName(fresh)


def check_bands(measures: DataFrame, specs: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """measures (any columns, rule, value) with the band of each spec (rule, lo, hi, slack): green within
    [lo, hi], amber within slack of it, else red. Specs are broadcast up to `most_rows` rows."""
    small = specs.limit(most_rows + 1).count() <= most_rows
    j = measures.join(F.broadcast(specs) if small else specs, "rule")
    v = F.col("value")
    band = F.when(v.between(F.col("lo"), F.col("hi")), "green").when(v.between(F.col("lo") - F.col("slack"), F.col("hi") + F.col("slack")), "amber").otherwise("red")
    return j.withColumn("band", band)


def numbered(df: DataFrame, group: str, order: list[str], count: Column) -> DataFrame:
    """df with _start: the running sum of `count` over groups in order, then over rows within a group; there
    may be any number of groups, of any size."""
    out = sum_before(df, [], [group, *order], count, "_start")
    return out.withColumn("_start", F.col("_start").cast("long"))


def place_on_grid(items: DataFrame, group: str, order: list[str], copies: str, rows: int, cols: int) -> DataFrame:
    """Every copy of every item with sheet, row and col (from 0), filled row by row, groups in order."""
    n = numbered(items, group, order, F.col(copies).cast("long")).where(F.col(copies) > 0)
    each = n.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).withColumn("number", F.col("_start") + F.col("copy") - 1)
    per, at = rows * cols, F.col("number")
    return each.withColumns({"sheet": F.floor(at / per), "row": F.floor(at % per / cols), "col": at % cols}).drop("_start")


def grid_capacity(papers: DataFrame, sizes: DataFrame, margin: float = 0.0, gap: float = 0.0, most_rows: int = 100_000) -> DataFrame:
    """papers (paper, width, height) x sizes (item, w, h, needed): columns, rows, per sheet, sheets needed
    (null if none fits). Sizes are broadcast up to `most_rows` rows."""

    def fit(whole: str, part: str) -> Column:
        return F.greatest(F.floor((F.col(whole) - 2 * margin + gap) / (F.col(part) + gap)), F.lit(0))

    j = product(papers, sizes, most_rows).withColumn("cols", fit("width", "w")).withColumn("rows", fit("height", "h"))
    j = j.withColumn("per_sheet", F.col("cols") * F.col("rows"))
    return j.withColumn("sheets", F.when(F.col("per_sheet") > 0, F.ceil(F.col("needed") / F.col("per_sheet"))))
