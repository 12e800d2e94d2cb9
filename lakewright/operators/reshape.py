"""Text, markup and tables of a corpus in other shapes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import element_rows, page_text
from ..functions.prefix import sum_before
from ..functions.text import table_cells


def html_tables(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(id, table, row, col, rowspan, colspan, text, filled) of every table cell, spans filled."""
    kind = dict(pages.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id, "table", "row", "col", "rowspan", "colspan", "text", "filled"]
        for pdf in batches:
            yield pd.DataFrame([(i, *c) for i, h in zip(pdf[id], pdf[html], strict=True) for c in table_cells(h or "")], columns=names)

    own = pages.select(id, html).where(F.col(html).rlike("(?i)<table"))
    return own.mapInPandas(run, f"{id} {kind}, table int, row int, col int, rowspan int, colspan int, text string, filled boolean")


def element_tree(pages: DataFrame, id: str, html: str, tags: list[str] | None = None, closed: bool = False) -> DataFrame:
    """(id, ord, parent, depth, tag, attributes, text) of the elements of some tags (None: all), nested ones
    too, in page order: see `elements`. Null and empty pages have none. For `closed` see `html_text`."""
    own = pages.select(F.col(id).alias("_id"), F.col(html).alias("_html"))
    rows = own.lateralJoin(element_rows(tags, closed)(F.col("_html").outer()))
    return rows.select(F.col("_id").alias(id), "ord", "parent", "depth", "tag", "attributes", "text")


def html_elements(pages: DataFrame, id: str, html: str, tag: str, attribute: str | None = None, closed: bool = False) -> DataFrame:
    """(id, ord, attribute, text) of the elements of a tag, in order; an attribute that isn't there is empty."""
    a = F.coalesce(F.try_element_at("attributes", F.lit(attribute.lower())), F.lit("")) if attribute else F.lit("")
    return element_tree(pages, id, html, [tag], closed).select(id, "ord", a.alias("attribute"), "text")


def html_text(pages: DataFrame, id: str, html: str, closed: bool = False) -> DataFrame:
    """(id, text) in reading order: scripts, styles and comments left out, tags as spaces, all references
    decoded, white space collapsed. A null page stays null. With `closed`, a reference without its semicolon
    (`&amp` where a text was cut) stays as it stands instead of being read as HTML does."""
    return pages.select(id, page_text(F.col(html), closed).alias("text"))


def lines(df: DataFrame, id: str, text: str, sep: str | None = None) -> DataFrame:
    """(id, pos, line), with sep also the line's fields."""
    out = df.select(id, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return out.withColumn("fields", F.split("line", sep)) if sep else out


def escaped(text: Column) -> Column:
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def to_markup(df: DataFrame, id: str, text: str, tag: str = "p") -> DataFrame:
    """(id, markup, round_trip): every line a block, every character kept; round_trip: undoing it gives the input."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit(f"<{tag}>"), escaped(x), F.lit(f"</{tag}>")))
    out = df.select(id, F.col(text).alias("_t"), F.array_join(parts, "\n").alias("markup"))
    back = F.replace(F.replace(F.col("markup"), F.lit(f"<{tag}>"), F.lit("")), F.lit(f"</{tag}>"), F.lit(""))
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        back = F.replace(back, F.lit(k), F.lit(v))
    return out.withColumn("round_trip", back.eqNullSafe(F.col("_t"))).drop("_t")


def chunk_lines(df: DataFrame, id: str, text: str, n: int, delim: str = "\f") -> DataFrame:
    """(id, chunk, body): cut at the delimiter where a text has one, else every n lines; nothing is dropped."""
    by_delim = F.split(text, delim, -1)
    all_lines = F.split(text, "\n", -1)
    starts = F.sequence(F.lit(0), F.size(all_lines) - 1, F.lit(n))
    by_lines = F.transform(starts, lambda s: F.array_join(F.slice(all_lines, s + 1, n), "\n"))
    return df.select(id, F.posexplode(F.when(F.col(text).contains(delim), by_delim).otherwise(by_lines)).alias("chunk", "body"))


def to_blocks(df: DataFrame, group: str, order: list[str], cols: list[str], sep: str = "\t") -> DataFrame:
    """(group, block): a header and the group's rows in order, as delimited lines."""
    row = F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    body = F.expr("array_join(transform(array_sort(collect_list(_s)), x -> x._r), '\n')")
    out = df.select(group, F.struct(*order, row.alias("_r")).alias("_s")).groupBy(group).agg(body.alias("_b"))
    return out.select(group, F.concat_ws("\n", F.lit(sep.join(cols)), "_b").alias("block"))


def labelled_blocks(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """(group, block, label, rows): the group's rows in order cut into blocks of n, labelled first-last."""
    numbered = sum_before(df.select(group, order), [group], [order], F.lit(1), "_n")
    b = numbered.select(group, order, F.floor(F.col("_n") / n).cast("int").alias("block"))
    label = F.concat_ws("-", F.min(order).cast("string"), F.max(order).cast("string"))
    return b.groupBy(group, "block").agg(label.alias("label"), F.count(F.lit(1)).alias("rows"))


def concat_parts(df: DataFrame, keys: list[str], order: str, text: str, sep: str = "\n") -> DataFrame:
    """(keys, text): the parts joined in order."""
    body = F.expr("transform(array_sort(collect_list(_s)), x -> x._t)")
    s = F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("_t")).alias("_s")
    return df.select(*keys, s).groupBy(*keys).agg(F.array_join(body, sep).alias(text))


def merge_outlines(df: DataFrame, key: str, source: str, order: str, title: str, level: str) -> DataFrame:
    """(key, source, ord, level, title): each source a top entry (ord -1, level 0), its own outline below."""
    top = df.select(key, source).distinct().select(key, source, F.lit(-1).cast("int").alias("ord"), F.lit(0).alias("level"), F.col(source).cast("string").alias("title"))
    own = df.select(key, source, F.col(order).cast("int").alias("ord"), (F.col(level) + 1).cast("int").alias("level"), F.col(title).alias("title"))
    return top.unionByName(own)


def unique_names(df: DataFrame, name: str, order: list[str], stem: Column | None = None, ext: Column | None = None) -> DataFrame:
    """df with new_name and renamed: the second of a name becomes `name (1).ext` and so on, in order.

    `stem` and `ext` say what stands before and after the number, by default the name up to its last dot and
    the rest. A made name that an existing one already has takes the next free number; rounds repeat until no name
    comes twice. Names are hash-partitioned, so the work follows the most frequent name.
    """
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1) if stem is None else stem
    ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2) if ext is None else ext
    rn = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    out = df.withColumn("_n", rn).withColumn("_fixed", F.col("_n") == 0)

    def made() -> Column:
        return F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))

    from ..functions.lineage import cut

    while True:  # each round the names that clash get higher numbers, so it ends
        first = F.row_number().over(W.partitionBy("new_name").orderBy(F.desc("_fixed"), F.col("_n"), *order))
        out = cut(out.withColumn("new_name", made()).withColumn("_rank", first))
        if out.where("_rank > 1").isEmpty():
            return out.withColumn("renamed", F.col("new_name") != F.col(name)).drop("_n", "_fixed", "_rank")
        top = out.groupBy(name).agg(F.max("_n").alias("_top"))
        late = F.sum(F.when(F.col("_rank") > 1, 1).otherwise(0)).over(W.partitionBy(name).orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
        out = out.withColumn("_late", late).join(top, name).withColumn("_n", F.when(F.col("_rank") > 1, F.col("_top") + F.col("_late")).otherwise(F.col("_n"))).drop("_late", "_top", "_rank", "new_name")


def page_names(df: DataFrame, name: str, page: str, width: int = 3) -> DataFrame:
    """df with page_name: `name_p001`; numbers beyond the width keep their digits."""
    number = F.col(page).cast("string")
    return df.withColumn("page_name", F.concat(F.col(name), F.lit("_p"), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)))


def infer_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, type, n): long or decimal only if every value survives the round trip, else string; one scan."""
    checks = []
    for c in cols:
        v = F.col(c)
        long_ok = v.try_cast("bigint").cast("string").eqNullSafe(v)
        dec_ok = v.rlike(r"^-?(0|[1-9]\d{0,17})\.\d{1,9}$")
        checks += [F.bool_and(F.when(v.isNotNull(), long_ok)).alias(f"{c}__l"), F.bool_and(F.when(v.isNotNull(), long_ok | dec_ok)).alias(f"{c}__d"), F.count(v).alias(f"{c}__n")]
    one = df.agg(*checks)
    kind = lambda c: F.when(F.col(f"{c}__l"), "long").when(F.col(f"{c}__d"), "decimal").otherwise("string")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), kind(c).alias("type"), F.col(f"{c}__n").alias("n")) for c in cols))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def rank_above_mode(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(keys, size, body, level): the group's most frequent size (the smaller among equals) is the body;
    larger sizes are levels 1, 2, ... from the largest."""
    counts = df.groupBy(*keys, size).agg(F.count(F.lit(1)).alias("_n"))
    body = counts.groupBy(*keys).agg(F.min_by(size, F.struct(-F.col("_n"), F.col(size))).alias("body"))
    return counts.join(body, keys).where(F.col(size) > F.col("body")).select(
        *keys, size, "body", F.dense_rank().over(W.partitionBy(*keys).orderBy(F.desc(size))).alias("level"))


def merge_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables by column name, missing columns null, with their source."""
    tagged = [df.withColumn("source", F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
