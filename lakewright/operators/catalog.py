"""Nested catalogues as tables, expansion, overlay and integrity rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS_SCHEMA = """features map<string, struct<label: string, visual: boolean>>,
formats map<string, struct<short: string, label: string, ext: array<string>, roles: array<string>, transit: boolean,
targetModes: array<string>, normalizeTo: string, pixels: boolean, note: string, caps: map<string, string>, sourceCaps: map<string, string>>>"""
ROUTES_SCHEMA = """engines map<string, struct<label: string, detail: string>>,
edges array<struct<id: string, engine: string, `from`: array<string>, `to`: array<string>, pairs: array<array<string>>,
modes: map<string, double>, finalOnly: boolean, summary: string, losses: string>>,
overrides array<struct<source: string, target: string, modes: array<string>, chain: array<string>, reason: string>>"""
#: Levels in order, and modes.
LEVELS, MODES = ("none", "partial", "full"), ("exact", "editable")


def level(name: Column) -> Column:
    """0, 1 or 2 for none, partial and full; null for anything else."""
    return F.when(name == "none", 0).when(name == "partial", 1).when(name == "full", 2).cast("tinyint")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("catalog", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))


def load_catalog(spark: SparkSession, formats_path: str, routes_path: str) -> dict[str, DataFrame]:
    """The tables of JSON documents in files, one or many; `catalog` is the name of a document's folder."""
    return catalog_tables(_read(spark, formats_path, FORMATS_SCHEMA), _read(spark, routes_path, ROUTES_SCHEMA))


def parse_catalogs(documents: DataFrame, catalog: str, formats: str, routes: str) -> dict[str, DataFrame]:
    """The tables of JSON documents in text columns, a catalogue in each row, so that any number of them is
    spread like any other table."""

    def side(column: str, schema: str) -> DataFrame:
        return documents.select(F.col(catalog).alias("catalog"), F.from_json(column, schema).alias("_d")).select("catalog", "_d.*")

    return catalog_tables(side(formats, FORMATS_SCHEMA), side(routes, ROUTES_SCHEMA))


def catalog_tables(f: DataFrame, r: DataFrame) -> dict[str, DataFrame]:
    """Parsed documents (with `catalog`) as normalised tables: features, formats, caps, source_caps, engines,
    raw_edges, edges, expanded (edges, each with its list of losses), edge_losses, overrides."""
    formats = f.select("catalog", F.posexplode("formats").alias("ord", "format", "v"))
    raw = r.select("catalog", F.posexplode("edges").alias("raw_ord", "v")).select("catalog", "raw_ord", "v.*")
    expanded = expand_edges(raw)
    return {
        "features": f.select("catalog", F.posexplode("features").alias("ord", "feature", "v")).select("catalog", "feature", "ord", "v.label", "v.visual"),
        "formats": formats.select(
            "catalog", "format", "ord", "v.short", "v.label", "v.ext", "v.roles", F.coalesce("v.transit", F.lit(False)).alias("transit"),
            F.col("v.targetModes").alias("target_modes"), F.col("v.normalizeTo").alias("normalize_to"), F.coalesce("v.pixels", F.lit(False)).alias("pixels"), "v.note",
        ),
        "caps": formats.select("catalog", "format", F.explode("v.caps").alias("feature", "level")),
        "source_caps": formats.select("catalog", "format", F.explode("v.sourceCaps").alias("feature", "level")),
        "engines": r.select("catalog", F.explode("engines").alias("engine", "v")).select("catalog", "engine", "v.label", "v.detail"),
        "raw_edges": raw,
        "edges": expanded.drop("losses"),
        "expanded": expanded,
        "edge_losses": expanded.select("catalog", "edge_ord", F.posexplode("losses").alias("pos", "l")).select("catalog", "edge_ord", "pos", "l.text", "l.if_source_has"),
        "overrides": r.select("catalog", F.explode("overrides").alias("v")).select("catalog", "v.source", "v.target", F.explode(F.coalesce("v.modes", F.array(*map(F.lit, MODES)))).alias("mode"), "v.chain", "v.reason"),
    }


def _losses(raw: Column, dst: Column) -> Column:
    """Losses of an expanded edge: a list, or by target with '*' first; an item is a text or an object."""
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    keyed = F.when(raw.startswith("{"), F.from_json(raw, "map<string, string>"))
    items = F.concat(
        F.coalesce(F.from_json(keyed["*"], "array<string>"), F.array().cast("array<string>")),
        F.coalesce(F.from_json(keyed[dst], "array<string>"), F.array().cast("array<string>")),
    )
    texts = F.coalesce(listed, items)
    return F.transform(
        texts,
        lambda x: F.struct(
            F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x).alias("text"),
            F.when(x.startswith("{"), F.get_json_object(x, "$.ifSourceHas")).alias("if_source_has"),
        ),
    )


def expand_pairs(pairs: Column, left: Column, right: Column) -> Column:
    """The given pairs, else every left with every right, in order."""
    return F.coalesce(pairs, F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.array(a, b)))))


def expand_edges(raw: DataFrame) -> DataFrame:
    """One row for each (edge, source, target, mode); edge_ord orders (edge, source, target) within a
    catalogue: the edge's place in the upper, the pair's in the lower 32 bits. Costs are exact decimals."""
    keys = ["catalog"] if "catalog" in raw.columns else []
    pairs = raw.select("*", F.posexplode(expand_pairs(F.col("pairs"), F.col("from"), F.col("to"))).alias("pair_ord", "pair"))
    out = pairs.withColumns({
        "edge_ord": F.shiftleft(F.col("raw_ord").cast("long"), 32) + F.col("pair_ord"), "src": F.col("pair")[0], "dst": F.col("pair")[1],
    })
    out = out.withColumn("losses", _losses(F.col("losses"), F.col("dst"))) if "losses" in raw.columns else out
    return out.select(
        *keys, "edge_ord", F.col("id").alias("edge_id"), "src", "dst", "engine", F.explode("modes").alias("mode", "_cost"),
        F.coalesce("finalOnly", F.lit(False)).alias("final_only"), "summary", *(["losses"] if "losses" in raw.columns else []),
    ).withColumn("cost", F.col("_cost").cast("decimal(10,4)")).drop("_cost")


def overlay(base: DataFrame, patch: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with the patch's value where the patch has the key and the value isn't null."""
    p = patch.select(*keys, F.col(value).alias("_patch"))
    return base.join(p, keys, "left").withColumn(value, F.coalesce("_patch", value)).drop("_patch")


@dataclass
class Rule:
    """One integrity rule over a table: kind is not_null, unique, in_set, fk, complete_cross, range or row_expr.

    `key` names the columns that identify a row in a violation. fk: `column` must occur in `other` of table
    `to`. complete_cross: every pair of the two `axes` (table, column) must occur as `columns`. range: a
    number between low and high, NaN and booleans rejected. row_expr: `expr` must be true.

    Where tables hold several catalogues (column catalog), each is judged by itself: keys begin with its
    name, and `to` and the axes count within it.
    """

    name: str
    table: str
    kind: str
    key: list[str] = field(default_factory=list)
    column: str = ""
    values: tuple = ()
    to: str = ""
    other: str = ""
    axes: tuple = ()
    columns: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    expr: str = ""


def _violations(tables: dict[str, DataFrame], r: Rule) -> DataFrame:
    df = tables[r.table]

    def graph(*names: str) -> list[str]:
        return ["catalog"] if all("catalog" in tables[t].columns for t in (r.table, *names)) else []

    by = [*graph(), *r.key]
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in by)) if by else F.lit("")

    def out(bad: DataFrame, detail: Column) -> DataFrame:
        return bad.select(F.lit(r.name).alias("rule"), key.alias("key"), detail.cast("string").alias("detail"))

    c = F.col(r.column) if r.column else None
    if r.kind == "not_null":
        return out(df.where(c.isNull()), F.lit(f"{r.column} is null"))
    if r.kind == "unique":
        many = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        return out(many, F.concat(F.col("_n").cast("string"), F.lit(" rows")))
    if r.kind == "in_set":
        return out(df.where(c.isNotNull() & ~c.isin(*r.values)), c)
    if r.kind == "fk":
        g = graph(r.to)
        to = tables[r.to].select(*g, F.col(r.other).alias(r.column)).distinct()
        return out(df.where(c.isNotNull()).join(to, [*g, r.column], "left_anti"), c)
    if r.kind == "complete_cross":
        (t1, c1), (t2, c2) = r.axes
        a, b = r.columns
        g = graph(t1, t2)
        axis1, axis2 = tables[t1].select(*g, F.col(c1).alias(a)).distinct(), tables[t2].select(*g, F.col(c2).alias(b)).distinct()
        every = axis1.join(axis2, g) if g else axis1.crossJoin(axis2)  # every pair is what is asked for
        missing = every.join(df.select(*g, a, b).distinct(), [*g, a, b], "left_anti")
        return missing.select(F.lit(r.name).alias("rule"), F.concat_ws("|", *g, a, b).alias("key"), F.lit("missing").alias("detail"))
    if r.kind == "range":
        kind = dict(df.dtypes)[r.column]
        if kind == "boolean":
            return out(df, c)
        x = c.cast("double")
        bad = x.isNull() | F.isnan(x)
        bad = bad | (x < r.low) if r.low is not None else bad
        bad = bad | (x > r.high) if r.high is not None else bad
        return out(df.where(bad), c)
    if r.kind == "row_expr":
        return out(df.where(~F.coalesce(F.expr(r.expr), F.lit(False))), F.lit(r.expr))
    raise ValueError(f"unknown kind of rule: {r.kind}")


def check(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """All violations (rule, key, detail) of the rules."""
    return reduce(DataFrame.unionByName, [_violations(tables, r) for r in rules])


def catalog_rules() -> list[Rule]:
    """The rules of a catalogue as load_catalog gives it."""
    return [
        Rule("format needs a label", "formats", "not_null", ["format"], "label"),
        Rule("format needs roles", "formats", "not_null", ["format"], "roles"),
        Rule("caps are complete", "caps", "complete_cross", axes=(("formats", "format"), ("features", "feature")), columns=("format", "feature")),
        Rule("caps name known features", "caps", "fk", ["format", "feature"], "feature", to="features", other="feature"),
        Rule("source caps name known features", "source_caps", "fk", ["format", "feature"], "feature", to="features", other="feature"),
        Rule("caps have known levels", "caps", "in_set", ["format", "feature"], "level", LEVELS),
        Rule("source caps have known levels", "source_caps", "in_set", ["format", "feature"], "level", LEVELS),
        Rule("target modes are known", "formats", "row_expr", ["format"], expr="target_modes is null or forall(target_modes, m -> m in ('exact', 'editable'))"),
        Rule("a target has modes", "formats", "row_expr", ["format"], expr="not coalesce(array_contains(roles, 'target'), false) or coalesce(size(target_modes), 0) > 0"),
        Rule("normalised form is known", "formats", "fk", ["format"], "normalize_to", to="formats", other="format"),
        Rule("an edge has an id", "raw_edges", "row_expr", ["raw_ord"], expr="id <> ''"),
        Rule("edge ids are unique", "raw_edges", "unique", ["id"]),
        Rule("an edge has modes", "raw_edges", "row_expr", ["id"], expr="coalesce(size(modes), 0) > 0"),
        Rule("edge modes are known", "edges", "in_set", ["edge_id", "src", "dst"], "mode", MODES),
        Rule("costs aren't negative", "edges", "range", ["edge_id", "src", "dst", "mode"], "cost", low=0.0),
        Rule("an edge has an engine", "raw_edges", "not_null", ["id"], "engine"),
        Rule("engines are known", "raw_edges", "fk", ["id"], "engine", to="engines", other="engine"),
        Rule("edge sources are known", "edges", "fk", ["edge_id"], "src", to="formats", other="format"),
        Rule("edge targets are known", "edges", "fk", ["edge_id"], "dst", to="formats", other="format"),
        Rule("no edge leads to itself", "edges", "row_expr", ["edge_id", "src"], expr="src <> dst"),
        Rule("losses name known features", "edge_losses", "fk", ["edge_ord", "pos"], "if_source_has", to="features", other="feature"),
        Rule("an override's chain has its ends", "overrides", "row_expr", ["source", "target", "mode"], expr="chain[0] = source and chain[size(chain) - 1] = target"),
    ]


def membership(df: DataFrame, array: str, value=None) -> DataFrame:
    """Rows whose array holds the value; without one, how many rows hold each member."""
    if value is not None:
        return df.where(F.array_contains(array, value))
    return df.select(F.explode(F.array_distinct(array)).alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("rows"))


def explode_json(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, key, value: the members of a flat JSON object, values as text; null JSON gives none."""
    return df.select(*keys, F.explode(F.from_json(column, "map<string, string>")).alias("key", "value"))
