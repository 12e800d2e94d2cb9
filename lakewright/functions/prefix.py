"""Running sums over any number of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def sum_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before each one in order, within its keys (none: over
    all rows), 0 for the first; nulls count as 0. The order of ties is any.

    Rows are dealt out by ranges of (keys, order), written once so that a lost task finds the same ranges
    again, and summed inside each range; a row for each key and range then gives every range its opening.
    A group of any size is so spread over tasks; the openings are windowed by key, at most one row a range.
    """
    spread = df.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*keys, *order)
    placed = cut(spread.withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    openings = sums.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_open"))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return own.join(openings, same).withColumn(name, F.col("_open") + F.col("_own")).select(*df.columns, name)
