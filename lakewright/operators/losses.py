"""What a route loses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import overlay
from .paths import GRAPH

KEYS = ["source", "target", "mode"]


def _graph(*tables: DataFrame) -> list[str]:
    """The catalogue's column, if all tables have it."""
    return [GRAPH] if all(GRAPH in t.columns for t in tables) else []


def path_losses(routes: DataFrame, caps: DataFrame, source_caps: DataFrame | None = None) -> DataFrame:
    """The weakest link of every feature: what the source has (overlay first) against the least level over
    the chain after the source. caps: format, feature, level (0-2). Rows: keys, feature, have, keep, level."""
    g = _graph(routes, caps)
    have = caps.select(*g, "format", "feature", "level")
    have = overlay(have, source_caps, [*g, "format", "feature"], "level") if source_caps is not None else have
    have = have.where("level > 0").select(*g, F.col("format").alias("source"), "feature", F.col("level").alias("have"))
    way = routes.select(*g, *KEYS, F.explode(F.expr("slice(chain, 2, size(chain) - 1)")).alias("format"))
    keep = way.join(caps.select(*g, "format", "feature", "level"), [*g, "format"]).groupBy(*g, *KEYS, "feature").agg(F.min("level").alias("keep"))
    return keep.join(have, [*g, "source", "feature"]).where("keep < have").select(
        *g, *KEYS, "feature", "have", "keep", F.when(F.col("keep") == 0, "lost").otherwise("reduced").alias("level"))


def step_losses(routes: DataFrame, edge_losses: DataFrame, source_caps: DataFrame) -> DataFrame:
    """keys, texts: the steps' loss texts in order, each once; a conditional one only if the source has the
    feature. edge_losses: edge_ord, pos, text, if_source_has. source_caps: format, feature, level (0-2)."""
    g = _graph(routes, edge_losses, source_caps)
    steps = routes.select(*g, *KEYS, F.posexplode("edge_ords").alias("step", "edge_ord")).join(edge_losses, [*g, "edge_ord"])
    has = source_caps.where("level > 0").select(*g, F.col("format").alias("source"), F.col("feature").alias("if_source_has"), F.lit(True).alias("_has"))
    kept = steps.join(has, [*g, "source", "if_source_has"], "left").where("if_source_has is null or _has")
    return kept.groupBy(*g, *KEYS).agg(
        F.expr("array_distinct(transform(array_sort(collect_list(struct(step, pos, text))), x -> x.text))").alias("texts"))


def summarise_losses(
    routes: DataFrame, losses: DataFrame, steps: DataFrame, formats: DataFrame, features: DataFrame, none: str = "None expected", folded: str = "Flattened to pixels"
) -> DataFrame:
    """keys, summary: a pixel target folds visual losses into one phrase; then Lost, Partial, step texts."""
    g = _graph(routes, losses, steps, formats, features)
    named = losses.join(features.select(*g, "feature", "label", "visual", "ord"), [*g, "feature"]).join(
        formats.select(*g, F.col("format").alias("target"), "pixels"), [*g, "target"])
    fold = F.col("pixels") & F.col("visual")

    agg = named.groupBy(*g, *KEYS).agg(
        F.bool_or(fold).alias("fold"),
        F.array_sort(F.collect_list(F.when(~fold & (F.col("level") == "lost"), F.struct("ord", "label")))).alias("lost"),
        F.array_sort(F.collect_list(F.when(~fold & (F.col("level") == "reduced"), F.struct("ord", "label")))).alias("partial"),
    )
    keys = [*g, *KEYS]
    df = routes.select(*keys).join(agg, keys, "left").join(steps, keys, "left")

    def part(prefix: str, column: str):
        listed = F.expr(f"array_join(transform({column}, x -> x.label), ', ')")
        return F.when(F.size(column) > 0, F.concat(F.lit(prefix), listed))

    summary = F.concat_ws("; ", F.when(F.col("fold"), folded), part("Lost: ", "lost"), part("Partial: ", "partial"), F.when(F.size("texts") > 0, F.array_join("texts", "; ")))
    return df.select(*keys, F.when(summary == "", none).otherwise(summary).alias("summary"))


def preflight_warnings(census: DataFrame, losses: DataFrame) -> DataFrame:
    """Predicted losses of the features that a document has: census (doc, target, mode, feature, n) with
    losses (target, mode, feature, level)."""
    shared = [c for c in ("source", "target", "mode", "feature") if c in census.columns and c in losses.columns]
    return census.where("n > 0").join(losses, shared)
