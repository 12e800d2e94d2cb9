"""Constrained cheapest paths, pinned routes, requests."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: The column that tells catalogues apart where a table holds several.
GRAPH = "catalog"
#: A label's order: cost, hops, then the costs on the way back to the source, then the edges in order.
RANK = "struct(cost, hops, reverse(costs) as back, edge_ords)"


def _least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best label of each key, with its columns."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.expr(RANK)).alias("_l"))
    return picked.select(*keys, "_l.*")


def cheapest_paths(
    edges: DataFrame,
    nodes: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    max_hops: int | None = None,
    keys: tuple[str, ...] = ("mode",),
) -> DataFrame:
    """The cheapest path of every (source, target) and key at once, on the smallest order RANK.

    edges: src, dst, edge_ord, cost (0 or more), final_only and the key columns. nodes: node, transit,
    normalize_to. sources, targets: one column node. A node may be left if it is the source, a transit
    node, or the source's normalised form; a final-only edge may only be the last one; no node comes twice.
    Edges are written once. Inner ones are followed in rounds from the labels that improved last, until none
    does; final-only edges make one join at the end. Rows: source, target, keys, chain, edge_ords, cost,
    hops. Edges and labels are joined by key, so neither is collected; there are at most |sources| x
    |reachable nodes| labels. max_hops: where a path may have so many edges only, each number of hops keeps
    a label of its own, as a dearer but shorter one may be the one to go on. Many graphs run at once if
    nodes, sources and targets hold one of the keys too (such as catalog).
    """
    k, edges = list(keys), cut(edges)
    graph = [c for c in k if c in nodes.columns]
    node = nodes.select(*graph, F.col("node"), F.coalesce("transit", F.lit(False)).alias("transit"))
    legacy = nodes.select(*graph, F.col("node").alias("source"), "normalize_to")
    inner = edges.where(~F.coalesce("final_only", F.lit(False))).select(*k, "src", "dst", "edge_ord", F.col("cost").alias("_c"))
    last = edges.where(F.coalesce("final_only", F.lit(False))).select(*k, "src", "dst", "edge_ord", F.col("cost").alias("_c"))
    cost_type = dict(edges.dtypes)["cost"]
    cost_type = "decimal(20,4)" if cost_type.startswith("decimal") else cost_type
    start = sources.select(*graph, F.col("node").alias("source")).distinct().join(legacy, [*graph, "source"], "left")
    kinds = edges.select(*k).distinct()
    start = start.join(kinds, graph) if graph else start.crossJoin(kinds) if k else start  # the modes of a graph
    start = start.select(
        "source", *k, F.col("source").alias("node"), F.lit(0).cast(cost_type).alias("cost"), F.lit(0).alias("hops"),
        F.array().cast(f"array<{cost_type}>").alias("costs"), F.array().cast("array<long>").alias("edge_ords"), F.array("source").alias("chain"), "normalize_to",
    )
    key = ["source", *k, "node"]

    def leave(labels: DataFrame, by: DataFrame) -> DataFrame:
        free = labels.join(node, [*graph, "node"], "left").where("node = source or transit or node <=> normalize_to").drop("transit")
        step = free.join(by.withColumnRenamed("src", "node"), [*k, "node"]).where("not array_contains(chain, dst)")
        return step.select(
            "source", *k, F.col("dst").alias("node"), (F.col("cost") + F.col("_c")).cast(cost_type).alias("cost"), (F.col("hops") + 1).alias("hops"),
            F.concat("costs", F.array(F.col("cost"))).alias("costs"), F.concat("edge_ords", F.array(F.col("edge_ord").cast("long"))).alias("edge_ords"),
            F.concat("chain", F.array("dst")).alias("chain"), "normalize_to",
        )

    best = frontier = cut(start)
    label = key if max_hops is None else [*key, "hops"]
    for _ in count() if max_hops is None else range(max_hops):
        found = cut(_least(best.unionByName(leave(frontier, inner)), label))
        old = best.select(*label, F.col("edge_ords").alias("_old"))
        frontier = found.join(old, label, "left").where("not (edge_ords <=> _old)").drop("_old")
        best = found
        if frontier.isEmpty():
            break
    short = best if max_hops is None else best.where(F.col("hops") < max_hops)
    ends = best.where("hops > 0").unionByName(leave(short, last))
    goal = targets.select(*graph, "node").distinct()
    return _least(ends.join(goal, [*graph, "node"], "left_semi"), key).select(
        "source", F.col("node").alias("target"), *k, "chain", "edge_ords", "cost", "hops"
    )


def apply_overrides(routes: DataFrame, overrides: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("mode",)) -> DataFrame:
    """routes with the pinned ones in place of theirs; adds override_reason and error.

    overrides: source, target, keys, chain, reason. For each step of a chain the cheapest edge counts, the
    first in order among equals; a missing edge makes an error row without edges and cost.
    """
    k = list(keys)
    steps = overrides.select(
        "source", "target", *k, "chain", "reason",
        F.posexplode(F.expr("transform(sequence(0, size(chain) - 2), i -> struct(chain[i] as src, chain[i + 1] as dst))")).alias("pos", "s"),
    ).select("source", "target", *k, "chain", "reason", "pos", "s.src", "s.dst")
    cheapest = edges.groupBy(*k, "src", "dst").agg(F.min(F.struct("cost", "edge_ord")).alias("e"))
    joined = steps.join(cheapest, [*k, "src", "dst"], "left")
    gap = F.concat(F.lit("no edge "), F.col("src").cast("string"), F.lit(" > "), F.col("dst").cast("string"))
    pinned = joined.groupBy("source", "target", *k, "chain", "reason").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, e.edge_ord))), x -> x.edge_ord)").alias("edge_ords"),
        F.sum("e.cost").alias("cost"), F.count(F.lit(1)).cast("int").alias("hops"), F.min(F.when(F.col("e").isNull(), gap)).alias("error"),
    )
    pinned = pinned.select(
        "source", "target", *k, "chain", F.when(F.col("error").isNull(), F.col("edge_ords").cast("array<long>")).alias("edge_ords"),
        F.when(F.col("error").isNull(), F.col("cost").cast(dict(routes.dtypes)["cost"])).alias("cost"), "hops", F.col("reason").alias("override_reason"), "error",
    )
    rest = routes.join(overrides.select("source", "target", *k).distinct(), ["source", "target", *k], "left_anti")
    return rest.withColumns({"override_reason": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).unionByName(pinned)


def effective_mode(mode: Column, target_modes: Column) -> Column:
    """The mode if the target has it, else the target's first one."""
    return F.when(F.array_contains(target_modes, mode), mode).otherwise(F.get(target_modes, F.lit(0)))


def plan_requests(requests: DataFrame, formats: DataFrame, routes: DataFrame, modes: tuple[str, ...], most_rows: int = 1_000_000) -> DataFrame:
    """Each request (source, target, mode, any further columns) with its route or the first reason against.

    formats: format, roles, target_modes. routes: source, target, mode, cost, hops, chain; they are written
    once. Either table is broadcast only up to `most_rows` rows; beyond, it is joined by key.
    """
    routes = cut(routes)
    g = [GRAPH] if all(GRAPH in df.columns for df in (requests, formats, routes)) else []
    src = formats.select(*g, F.col("format").alias("source"), F.col("roles").alias("_sr"))
    dst = formats.select(*g, F.col("format").alias("target"), F.col("roles").alias("_tr"), F.col("target_modes").alias("_tm"))

    def fit(df: DataFrame) -> bool:
        return df.limit(most_rows + 1).count() <= most_rows

    hint = F.broadcast if fit(formats) else (lambda x: x)
    hint_routes = F.broadcast if fit(routes) else (lambda x: x)
    r = routes.select(*g, "source", "target", F.col("mode").alias("effective_mode"), "cost", "hops", "chain")
    df = requests.join(hint(src), [*g, "source"], "left").join(hint(dst), [*g, "target"], "left")
    df = df.withColumn("effective_mode", effective_mode(F.col("mode"), F.col("_tm"))).join(hint_routes(r), [*g, "source", "target", "effective_mode"], "left")
    reason = (
        F.when(~F.coalesce(F.col("mode").isin(*modes), F.lit(False)), "unknown mode")
        .when(~F.coalesce(F.array_contains("_sr", "source"), F.lit(False)), "not a source")
        .when(~F.coalesce(F.array_contains("_tr", "target"), F.lit(False)), "not a target")
        .when(F.col("source") == F.col("target"), "same format")
        .when(F.col("cost").isNull(), "no route")
    )
    df = df.withColumn("reject_reason", reason).drop("_sr", "_tr", "_tm")
    for c in ("cost", "hops", "chain"):
        df = df.withColumn(c, F.when(F.col("reject_reason").isNull(), F.col(c)))
    return df


def all_requests(formats: DataFrame) -> DataFrame:
    """Every source with every other target, in the modes that the target has. A catalogue's formats are
    few; the pairs are what is asked for."""
    g = [GRAPH] if GRAPH in formats.columns else []
    src = formats.where(F.array_contains("roles", "source")).select(*g, F.col("format").alias("source"))
    dst = formats.where(F.array_contains("roles", "target")).select(*g, F.col("format").alias("target"), "target_modes")
    pairs = src.join(dst, g) if g else src.crossJoin(dst)
    return pairs.where("source <> target").select(*g, "source", "target", F.explode("target_modes").alias("mode"))


def path_invariants(routes: DataFrame, edges: DataFrame, nodes: DataFrame, forbidden: str | int | None = None) -> DataFrame:
    """For each route: whether its ends are right, no node comes twice, every step has the mode, final-only
    edges are last, and inner nodes may be left; all_hold joins them. edges have a mode column."""
    steps = routes.select("source", "target", "mode", F.size("edge_ords").alias("_n"), F.posexplode("edge_ords").alias("pos", "edge_ord"))
    e = edges.select(F.col("edge_ord"), F.col("mode"), F.col("final_only"))
    by_step = steps.join(e, ["edge_ord", "mode"], "left").groupBy("source", "target", "mode").agg(
        F.bool_and(F.col("final_only").isNotNull()).alias("modes_valid"),
        F.bool_and(~F.coalesce("final_only", F.lit(False)) | (F.col("pos") == F.col("_n") - 1)).alias("final_only_last"),
    )
    inner = routes.select("source", "target", "mode", F.explode(F.expr("slice(chain, 2, greatest(size(chain) - 2, 0))")).alias("node"))
    legacy = nodes.select(F.col("node").alias("source"), F.col("normalize_to"))
    by_node = inner.join(nodes.select("node", "transit"), "node", "left").join(legacy, "source", "left").groupBy("source", "target", "mode").agg(
        F.bool_and(F.coalesce("transit", F.lit(False)) | F.col("node").eqNullSafe(F.col("normalize_to"))).alias("inner_may_be_left"))
    keys = ["source", "target", "mode"]
    out = routes.join(by_step, keys, "left").join(by_node, keys, "left").select(
        *keys, ((F.col("chain")[0] == F.col("source")) & (F.element_at("chain", -1) == F.col("target"))).alias("ends_right"),
        (F.size(F.array_distinct("chain")) == F.size("chain")).alias("no_revisit"), F.coalesce("modes_valid", F.lit(False)).alias("modes_valid"),
        F.coalesce("final_only_last", F.lit(False)).alias("final_only_last"), F.coalesce("inner_may_be_left", F.lit(True)).alias("inner_may_be_left"),
        (~F.array_contains(F.expr("slice(chain, 2, greatest(size(chain) - 2, 0))"), forbidden) if forbidden is not None else F.lit(True)).alias("forbidden_outside"),
    )
    facts = ["ends_right", "no_revisit", "modes_valid", "final_only_last", "inner_may_be_left", "forbidden_outside"]
    return out.withColumn("all_hold", F.expr(" and ".join(facts)))
