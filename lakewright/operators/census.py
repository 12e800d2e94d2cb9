"""What a corpus holds, before anything is converted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import feature_rows

#: Script -> character class; RTL scripts.
SCRIPTS = {
    "latin": r"\p{IsLatin}", "greek": r"\p{IsGreek}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}",
    "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}", "digits": r"[0-9]",
}
RTL = ("arabic", "hebrew")
#: Feature -> its tags, and the attribute that a tag must have.
FEATURES = {
    "links": (("a",), "href"), "images": (("img",), None), "tables": (("table",), None), "headings": (("h1", "h2", "h3", "h4", "h5", "h6"), None),
    "lists": (("ul", "ol"), None), "notes": (("aside", "sup"), None), "paragraphs": (("p",), None), "scripts": (("script",), None),
}
#: The last code point.
LAST = 0x10FFFF
#: Characters, and about so many bytes of text, that are counted at a time.
SLICE = 1 << 18
#: Magic bytes in hex -> type.
SIGNATURES = {
    "25504446": "pdf", "504B0304": "zip", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif",
    "50415231": "parquet", "D0CF11E0A1B11AE1": "ole", "3C21444F43545950452068746D6C": "html", "3C3F786D6C": "xml", "7B5C727466": "rtf",
}


def signature_type(content: Column, signatures: dict[str, str] = SIGNATURES) -> Column:
    """The type with the longest matching signature, as one expression; null if none matches."""
    head = F.hex(F.substring(content, 1, max(map(len, signatures)) // 2))
    return F.coalesce(*(F.when(head.startswith(s), t) for s, t in sorted(signatures.items(), key=lambda x: -len(x[0]))))


def sniff(files: DataFrame, content: str = "content", claimed: str | None = None, signatures: dict[str, str] = SIGNATURES) -> DataFrame:
    """files with type by content, and whether it differs from the claimed one. The signature table is a
    fixed list, so it is part of the plan."""
    out = files.withColumn("type", signature_type(F.col(content).cast("binary"), signatures))
    return out.withColumn("mismatch", ~F.col("type").eqNullSafe(F.col(claimed))) if claimed else out


def code_classes(patterns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted begins of ranges of code points, the class of each range, and which patterns (rows: classes)
    hold for a class. A pattern is for one character; any number of patterns may hold for it."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, LAST + 1))))  # surrogates are no characters
    place = np.concatenate([np.arange(0xD800), np.arange(0xE000, LAST + 1)])
    held = np.zeros((LAST + 1, len(patterns)), bool)
    for k, p in enumerate(patterns):
        for m in regex.finditer(rf"(?:{p})+", every):
            held[place[m.start() : m.end()], k] = True
    begins = np.concatenate([[0], 1 + np.flatnonzero((held[1:] != held[:-1]).any(1))])
    members, kind = np.unique(held[begins], axis=0, return_inverse=True)
    return begins, kind.ravel().astype(np.uint8), members


def script_census(df: DataFrame, id: str, text: str, scripts: dict[str, str] = SCRIPTS) -> DataFrame:
    """(id, script, n) with n > 0: characters of each class, a pattern for one character.

    Each text is read once: its code points are looked up in one table (some hundred ranges, sent with the
    function), and classes are counted for some SLICE characters at a time. Null texts have no characters.
    """
    begins, kind, members = code_classes(tuple(scripts.values()))
    names, schema = list(scripts), df.select(id).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_code = np.repeat(kind, np.diff(np.append(begins, LAST + 1)))
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = np.zeros((part.num_rows, len(members)), np.int64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(t) for t in texts])
                whole = "".join(texts)
                for first in range(0, len(whole), SLICE):
                    codes = np.frombuffer(whole[first : first + SLICE].encode("utf-32-le"), np.uint32)
                    low, high = np.searchsorted(ends, (first, first + len(codes) - 1), side="right")
                    own = np.diff(np.clip(ends[low : high + 1], first, first + len(codes)), prepend=first)
                    row = np.repeat(np.arange(len(own)), own)
                    found[low : high + 1] += np.bincount(row * len(members) + by_code[codes], minlength=len(own) * len(members)).reshape(len(own), -1)
                n = found @ members.astype(np.int64)
                i, k = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array([names[x] for x in k], pa.string()), pa.array(n[i, k], pa.int64())], [id, "script", "n"])
        pa.default_memory_pool().release_unused()

    return df.select(id, text).mapInArrow(run, schema.add("script", "string").add("n", "long"))


def dominant_script(census: DataFrame, id: str) -> DataFrame:
    """id, script with the most letters (the first by name among equals), right_to_left."""
    return census.where("script <> 'digits'").groupBy(id).agg(
        F.min_by("script", F.struct(-F.col("n"), F.col("script"))).alias("script"), F.bool_or(F.col("script").isin(*RTL)).alias("right_to_left"))


def feature_census(pages: DataFrame, id: str, html: str, features: dict[str, tuple[tuple[str, ...], str | None]] = FEATURES) -> DataFrame:
    """(id, feature, n) with n > 0: start tags, not what looks like one in comments, scripts and attributes."""
    own = pages.select(F.col(id).alias("_id"), F.col(html).alias("_html"))
    return own.lateralJoin(feature_rows(features)(F.col("_html").outer())).select(F.col("_id").alias(id), "feature", "n")


def classify_units(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """df with class: the first rule that holds."""
    kind = F.lit(otherwise)
    for name, rule in reversed(rules):
        kind = F.when(rule, name).otherwise(kind)
    return df.withColumn("class", kind)


def split_apply_merge(df: DataFrame, class_col: str, fns: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each class through its own function, put together again; order keys stay columns, so that a reader
    sorts within a document instead of globally. Classes without a function pass as they are."""
    parts = [fn(df.where(F.col(class_col) == c)) for c, fn in fns.items()]
    rest = df.where(~F.coalesce(F.col(class_col).isin(*fns), F.lit(False)))
    return reduce(lambda a, b: a.unionByName(b), parts, rest)


#: Code points of a bin.
BIN = 256


def coverage_gaps(df: DataFrame, id: str, text: str, ranges: DataFrame) -> DataFrame:
    """(id, character, code, n) of characters outside every range (lo, hi).

    Characters are counted by document once; only the distinct ones of the corpus meet the ranges, of which
    there may be any number: both are dealt out by bins of code points, in which equal parts of ranges are one.
    Ranges of which hi is under lo, or an end is null, hold nothing.
    """
    chars = df.select(id, F.explode(F.split(text, "")).alias("character")).where("character <> ''")
    counted = chars.groupBy(id, "character").agg(F.count(F.lit(1)).alias("n"))
    distinct = counted.select("character").distinct().withColumn("code", F.ascii("character").cast("long")).withColumn("bin", F.shiftright("code", 8))
    own = ranges.select(F.greatest("lo", F.lit(0)).cast("long").alias("lo"), F.least("hi", F.lit(LAST)).cast("long").alias("hi"), (F.col("lo") <= F.col("hi")).alias("ok")).where("ok and lo <= hi")
    parts = own.withColumn("bin", F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8))))
    begin = F.col("bin") * BIN
    parts = parts.select("bin", F.greatest("lo", begin).alias("lo"), F.least("hi", begin + BIN - 1).alias("hi")).distinct()
    gaps = distinct.join(parts.withColumnRenamed("bin", "of"), (F.col("bin") == F.col("of")) & (F.col("code") >= F.col("lo")) & (F.col("code") <= F.col("hi")), "left_anti")
    return counted.join(gaps.drop("bin"), "character").select(id, "character", "code", "n")


def urls(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(id, url, kind, host): what a page links or loads; kind is data, remote or local."""
    found = F.explode(F.regexp_extract_all(html, F.lit(r"(?i)(?:href|src)=\"([^\"]*)\""), 1)).alias("url")
    u = F.col("url")
    kind = F.when(u.startswith("data:"), "data").when(u.rlike(r"^(?i)(?:https?:)?//"), "remote").otherwise("local")
    return pages.select(id, found).withColumn("kind", kind).withColumn("host", F.when(kind == "remote", F.lower(F.regexp_extract("url", r"^(?i)(?:https?:)?//([^/:?#]+)", 1))))


def resource_urls(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(kind, host, n, n_pages)."""
    return urls(pages, id, html).groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id).alias("n_pages"))


def fingerprint(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, size in bytes, sha256."""
    c = F.col(content).cast("binary")
    return files.select(key, F.octet_length(c).cast("long").alias("size"), F.sha2(c, 256).alias("sha256"))


def changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key, state: new, gone, changed or same, from two fingerprints."""
    j = now.select(key, F.col("sha256").alias("_n")).join(before.select(key, F.col("sha256").alias("_b")), key, "full")
    return j.select(key, F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_n") == F.col("_b"), "same").otherwise("changed").alias("state"))


def flag_low(df: DataFrame, keys: list[str], value: str, limit: float = 0.80) -> DataFrame:
    """keys, n, n_low (under the limit) and low_share."""
    low = F.count_if(F.col(value) < limit)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), low.alias("n_low"), (low / F.count(value)).alias("low_share"))
