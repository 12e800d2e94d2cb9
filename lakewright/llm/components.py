"""Connected components of a graph that no machine holds whole: alternating large and small stars.

Each partition first replaces its own links by a forest (exact: it spans the same components). Then, in
each round, every node links its larger neighbours, and afterwards its smaller ones, to the smallest node
it knows, until nothing changes (Kiveris et al., "Connected components in MapReduce and beyond", 2014).
No node's neighbours are ever gathered: each round is two minima by key with partial aggregation and two
joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written


def forest(a: list, b: list) -> list[tuple]:
    """(node, smallest node of its component) of these links, without the smallest ones themselves."""
    up: dict = {}

    def root(x):
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(up)]


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = forest(batch.column("u").to_pylist(), batch.column("v").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=LINKS)


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) for every node of a link, component being its smallest node.

    Links are undirected, of long ids; repeated links, both directions and self-links are allowed, null
    ends are left out. An empty table gives an empty one.
    """
    own = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    own = written(own.where("u is not null and v is not null"))  # read twice below
    edges = _cut(own.where("u <> v").mapInArrow(_local, "u long, v long").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = own.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return nodes.unionByName(roots).unionByName(alone.join(nodes.unionByName(roots).select("node"), "node", "left_anti"))
