"""What came out against what went in, for tables of any size."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import aligned_distance, edit_distance, lcs_length, nfkc


def normalised(text: Column, unicode: bool = True) -> Column:
    """NFKC, soft hyphens and line-end hyphenation removed, white space collapsed; joiners stay."""
    t = nfkc(text) if unicode else text
    t = F.regexp_replace(F.translate(t, "\u00ad", ""), r"(\p{L})-[ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f\x0B]+", " "))


def normalise_corpus(df: DataFrame, id: str, text: str, unicode: bool = True) -> DataFrame:
    """id, normalised text, and which rules changed it."""
    t = F.col(text)
    return df.select(
        id, normalised(t, unicode).alias(text), (~nfkc(t).eqNullSafe(t) if unicode else F.lit(False)).alias("nfkc_changed"),
        t.contains("\u00ad").alias("soft_hyphen"), t.rlike(r"\p{L}-[ \t]*\r?\n[ \t]*\p{Ll}").alias("line_hyphen"),
        t.rlike(r"[ \t\r\n\f\x0B]{2,}|[\t\r\n\f\x0B ]|^ | $").alias("white_space"),
    )


def tokens(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, pos, token): the text split at white space."""
    split = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return df.select(id, F.posexplode(split).alias("pos", "token"))


def multiset_diff(a: DataFrame, b: DataFrame, id: str, item: str) -> DataFrame:
    """(id, item, missing, extra): how often an item of a is missing in b, and the other way round."""
    x = a.groupBy(id, item).agg(F.count(F.lit(1)).alias("_a"))
    y = b.groupBy(id, item).agg(F.count(F.lit(1)).alias("_b"))
    n, m, zero = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)), F.lit(0).cast("long")
    return x.join(y, [id, item], "full").select(id, item, F.greatest(n - m, zero).alias("missing"), F.greatest(m - n, zero).alias("extra")).where("missing + extra > 0")


def with_context(toks: DataFrame, diff: DataFrame, id: str, n: int = 2) -> DataFrame:
    """The places of the differing tokens with n tokens before and after."""
    w = W.partitionBy(id).orderBy("pos").rowsBetween(-n, n)
    return toks.withColumn("context", F.array_join(F.collect_list("token").over(w), " ")).join(diff, [id, "token"])


#: What Java's \s is.
_SPACES = re.compile(r"[ \t\n\x0B\f\r]+")
#: Rows of a batch that Python hands back.
BATCH = 10_000


def _split(text: str | None) -> list[str]:
    return [t for t in _SPACES.split(text or "") if t]


def _counted(own: list[str | None], other: list[str | None], null: bool) -> Iterator[tuple[str, int, int]]:
    """(token, missing, extra) of an id's texts on both sides; rows without an id are nobody's other side."""
    x, y = (Counter(t for text in side for t in _split(text)) for side in (own, other))
    if null:
        yield from ((t, n, 0) for t, n in x.items())
        yield from ((t, 0, n) for t, n in y.items())
        return
    for t, n in x.items():
        m = y.get(t, 0)  # a Counter's [] is slow where there is none
        if n != m:
            yield (t, n - m, 0) if n > m else (t, 0, m - n)
    yield from ((t, 0, n) for t, n in y.items() if t not in x)


def _placed(own: list[str | None], other: list[str | None], null: bool, n: int) -> Iterator[tuple[str, int, str, int, int]]:
    """(token, pos, context, missing, extra) of the places of an id's differing tokens."""
    diff = {} if null else {t: (m, e) for t, m, e in _counted(own, other, null)}
    for toks in map(_split, own) if diff else ():
        line, begins = " ".join(toks), list(accumulate((len(t) + 1 for t in toks), initial=0))
        ends = begins[n + 1 :] + begins[-1:] * n  # an end is the next begin less the space
        for i, (t, begin, end) in enumerate(zip(toks, [0] * n + begins, ends)):  # noqa: B905  begins go on
            if t in diff:
                yield t, i, line[begin : end - 1], *diff[t]


def texts_diff(a: DataFrame, b: DataFrame, id: str, text: str, context: int | None = None) -> DataFrame:
    """`multiset_diff` of the tokens of a's and b's texts; with a context, `with_context` of a's places.

    The texts go to their id's task once and are counted there one id after the other, so that neither tokens
    nor contexts are shuffled or sorted.
    """
    head = a.select(id).schema.add("token", "string")
    schema = (head if context is None else head.add("pos", "long").add("context", "string")).add("missing", "long").add("extra", "long")
    types = [pa.string(), *([] if context is None else [pa.int64(), pa.string()]), pa.int64(), pa.int64()]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, list[str | None], list[str | None]]]:
        at, found = None, ([], [])
        for batch in batches:
            for k, t, side in zip(*batch.columns, strict=True):
                if at is None or k.as_py() != at.as_py():
                    if at is not None:
                        yield at, *found
                    at, found = k, ([], [])
                found[side.as_py()].append(t.as_py())
        if at is not None:
            yield at, *found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, keys, rows = pa.null(), [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *map(pa.array, zip(*rows, strict=True), types)], names=schema.names)

        for at, own, other in ids(batches):
            kind, k = at.type, at.as_py()
            for row in _counted(own, other, k is None) if context is None else _placed(own, other, k is None, context):
                keys.append(k)
                rows.append(row)
                if len(rows) == BATCH:
                    yield made()
                    keys, rows = [], []
        if rows:
            yield made()

    both = [df.select(id, F.col(text).alias("_text"), F.lit(n).alias("_side")) for n, df in enumerate((a, b))]
    return both[0].unionByName(both[1]).repartition(id).sortWithinPartitions(id).mapInArrow(run, schema)


#: Up to so many tokens of a pair take the built-in edit distance.
SHORT = 80


def _codes(tokens_: Column, all_: Column, base: int) -> Column:
    """One character for each distinct token of a pair, so that edit distance on strings is on tokens."""
    places = F.map_from_arrays(all_, F.sequence(F.lit(0), F.size(all_) - 1))
    return F.array_join(F.transform(tokens_, lambda t: F.decode(F.unhex(F.lpad(F.hex(places[t] + base), 4, "0")), "UTF-16BE")), "")


def token_similarity(pairs: DataFrame, a: str, b: str, most: int = 20_000) -> DataFrame:
    """pairs with distance and similarity = 1 - d / max(n, m) over token arrays; equal ones leave early.

    The built-in's coding has room for `most` tokens of a pair (from U+4E00 on) and is slow beyond SHORT;
    longer pairs go to bit vectors, which give the same distance at any length.
    """
    x, y = F.col(a), F.col(b)
    longest = F.greatest(F.size(x), F.size(y))
    every = F.array_distinct(F.concat(x, y))
    near = F.size(x) + F.size(y) <= min(most, SHORT)
    far = (x != y) & ~near
    d = F.when(x == y, 0).when(near, F.levenshtein(_codes(x, every, 0x4E00), _codes(y, every, 0x4E00)))
    d = d.otherwise(edit_distance(F.when(far, x), F.when(far, y)))
    out = pairs.withColumn("distance", d)
    return out.withColumn("similarity", F.when(x == y, 1.0).otherwise(1 - F.col("distance") / longest))


def aligned_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with distance and similarity = 1 - d / max(n, m), 1 for two empty arrays, over token arrays of any
    length: texts are aligned at runs of tokens that both hold once, in an order that both have, and only what
    lies between is compared. The distance is never less than that of `token_similarity`, and equal to it where
    the cheapest edits keep the anchors; null where an array is."""
    longest = F.greatest(F.size(a), F.size(b))
    out = pairs.withColumn("distance", aligned_distance(F.col(a), F.col(b)))
    return out.withColumn("similarity", F.when(longest == 0, 1.0).otherwise(1 - F.col("distance") / longest))


def order_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with lcs and order_score = lcs / max(n, m), 1 for two empty arrays."""
    longest = F.greatest(F.size(a), F.size(b))
    return pairs.withColumn("lcs", lcs_length(F.col(a), F.col(b))).withColumn("order_score", F.when(longest == 0, 1.0).otherwise(F.col("lcs") / longest))


def compare_counts(a: DataFrame, b: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys, kind, n_a, n_b, delta, equal."""
    x = a.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n_b"))
    out = x.join(y, [*keys, kind], "full").na.fill(0, ["n_a", "n_b"])
    return out.withColumn("delta", F.col("n_b") - F.col("n_a")).withColumn("equal", F.col("delta") == 0)


def compare_cells(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Cells that differ: keys, status (missing, extra, differs) and the differing columns."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, *(F.col(c).alias(f"{p}{c}") for c in cols), F.lit(True).alias(f"{p}is"))

    j = side(a, "_a").join(side(b, "_b"), keys, "full")
    differ = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_a{c}").eqNullSafe(F.col(f"_b{c}")), c) for c in cols))), ",")
    status = F.when(F.col("_bis").isNull(), "missing").when(F.col("_ais").isNull(), "extra").when(differ != "", "differs")
    return j.select(*keys, status.alias("status"), F.when(status == "differs", differ).otherwise("").alias("columns")).where("status is not null")


def compare_sets(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, side) of items that only one side has."""
    x = a.select(*keys, item).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys, item).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [*keys, item], "full").where("_a is null or _b is null")
    return j.select(*keys, item, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def classify_substitution(asked: DataFrame, present: DataFrame, compat: DataFrame, keys: list[str]) -> DataFrame:
    """keys, asked, present, class: same, compatible (the pair is in compat: asked, present), different or absent."""
    c = compat.select("asked", "present", F.lit(True).alias("_c")).distinct()
    j = asked.join(present, keys, "left").join(c, ["asked", "present"], "left")
    kind = F.when(F.col("present").isNull(), "absent").when(F.col("asked") == F.col("present"), "same").when(F.col("_c"), "compatible").otherwise("different")
    return j.select(*keys, "asked", "present", kind.alias("class"))


def all_at_least(df: DataFrame, keys: list[str], member: str, value: str, limit: float) -> DataFrame:
    """keys, passes (every member reaches the limit; a null doesn't), least, worst (its member, the smallest among equals)."""
    return df.groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col(value) >= limit, F.lit(False))).alias("passes"), F.min(value).alias("least"),
        F.min_by(member, F.struct(F.col(value), F.col(member))).alias("worst"),
    )


def classify_checks(checks: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """checks (keys, check, ok) with outcome: pass, expected (a predicted loss: keys, check) or fail."""
    e = expected.groupBy(*keys).agg(F.collect_set("check").alias("_e"))  # by the keys alone: checks stay where they are
    out = F.when(F.col("ok"), "pass").when(F.array_contains("_e", F.col("check")), "expected").otherwise("fail")
    return checks.join(e, keys, "left").withColumn("outcome", out).drop("_e")


def label_jobs(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label: Needs review if a check fails, Perfect if all pass, else Converted with expected changes."""
    return checks.groupBy(*keys).agg(job_label())


def job_label() -> Column:
    """The label of a group of checks, as an aggregate: see `label_jobs`."""
    label = F.when(F.bool_or(F.col("outcome") == "fail"), "Needs review").when(F.bool_and(F.col("outcome") == "pass"), "Perfect")
    return label.otherwise("Converted with expected changes").alias("label")


def match_by_hash(a: DataFrame, b: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, status: same, re-encoded (same place, other content), missing, extra."""
    x = a.select(*keys, F.sha2(F.col(content).cast("binary"), 256).alias("hash_a"))
    y = b.select(*keys, F.sha2(F.col(content).cast("binary"), 256).alias("hash_b"))
    j = x.join(y, keys, "full")
    return j.withColumn("status", F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").when(F.col("hash_a") == F.col("hash_b"), "same").otherwise("re-encoded"))
