"""Text functions that Spark has no built-in for, as vectorised functions over Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC; only text with characters beyond ASCII leaves the JVM's code."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _each(measure: Callable[[list, list], int], a: pa.Array, b: pa.Array) -> pa.Array:
    """A measure of each pair of token arrays, null where one is. Tokens are Python's for one pair at a time,
    so memory is the Arrow batch and the longest pair."""
    return pa.array([measure(x.values.to_pylist(), y.values.to_pylist()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.int32())


@F.arrow_udf(IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two token arrays, bit-parallel on integers."""
    return _each(_lcs, a, b)


def _lcs(a: list, b: list) -> int:
    """Bit vectors take len(a) * len(b) / 64 steps, piles a few for each pair of equal tokens: the lesser is done."""
    many, other = Counter(a), Counter(b)
    equal = sum(n * other[x] for x, n in many.items())
    return _lcs_piles(a, b) if equal * (1 + len(a).bit_length()) < len(a) * len(b) // 64 else _lcs_bits(a, b)


def _lcs_piles(a: list, b: list) -> int:
    """Longest chain of pairs of equal tokens: the places in `a` of each token of `b`, from the last to the
    first, go on the first pile whose top isn't before them. Memory is linear, whatever the number of pairs."""
    places: dict = {}
    for i in range(len(a) - 1, -1, -1):
        places.setdefault(a[i], []).append(i)
    tops: list[int] = []
    for y in b:
        for i in places.get(y, ()):
            k = bisect_left(tops, i)
            if k == len(tops):
                tops.append(i)
            else:
                tops[k] = i
    return len(tops)


def _lcs_bits(a: list, b: list) -> int:
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.arrow_udf(IntegerType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Levenshtein distance of two token arrays of any length, bit-parallel on integers."""
    return _each(_edits, a, b)


def _edits(a: list, b: list) -> int:
    """Myers' bit vectors as Hyyro computes them: `up` and `down` are the steps of a column by +1 and -1."""
    if not a:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, d = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for y in b:
        eq = places.get(y, 0)
        zero = ((eq & up) + up ^ up | eq | down) & full
        right, left = down | full & ~(zero | up), up & zero
        d += bool(right & last) - bool(left & last)
        right = (right << 1 | 1) & full
        up, down = (left << 1 | full & ~(zero | right)) & full, right & zero
    return d


@F.arrow_udf(IntegerType())
def aligned_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two token arrays along their anchors: see `_aligned`."""
    return _each(_aligned, a, b)


#: Tokens of an anchor.
GRAM = 5


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the runs of GRAM tokens that each side holds once, in an order that both have: the longest
    such chain."""
    def once(x: list) -> dict:
        found: dict = {}
        for i, g in enumerate(zip(*(x[k:] for k in range(GRAM)), strict=False)):
            found[g] = -1 if g in found else i
        return found

    own = once(b)
    pairs = [(i, j) for g, i in once(a).items() if i >= 0 and (j := own.get(g, -1)) >= 0]
    tops: list[int] = []
    at, before = [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):  # sorted by i already
        k = bisect_left(tops, j)
        tops[k : k + 1], at[k : k + 1] = [j], [n]
        before[n] = at[k - 1] if k else -1
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def _aligned(a: list, b: list) -> int:
    """Edit distance of what lies between anchors, added up: the cost of a real series of edits, so never
    less than the distance, and the same wherever the cheapest edits keep the anchors. Texts without anchors
    are compared as a whole. Works on the stretches alone, so long versions of one text take linear time."""
    if a == b:
        return 0
    total = x = y = 0
    for i, j in [*_anchors(a, b), (len(a), len(b))]:
        if i < x or j < y:  # within the anchor before, at another distance
            continue
        p, q = a[x:i], b[y:j]
        total += 0 if p == q else _edits(p, q)
        x, y = i + min(GRAM, len(a) - i), j + min(GRAM, len(b) - j)
    return total


_CELL = re.compile(r"<(/?)(table|tr|td|th)\b([^>]*)>", re.I)
#: Fixed values of HTML: the largest spans.
_MOST = {"row": 65_534, "col": 1_000}
_SPAN = re.compile(r"(row|col)span\s*=\s*[\"']?(\d+)", re.I)


def table_cells(html: str) -> list[tuple[int, int, int, int, int, str, bool]]:
    """(table, row, column, rowspan, colspan, text, filled) of every cell place of a page's tables; a place
    that a span covers repeats its cell, with filled true. Tables within cells come out as tables of
    their own."""
    from html import unescape

    out, stack, tables, at = [], [], 0, 0
    parts = []

    def done(cell: dict) -> None:
        text = " ".join(unescape(re.sub(r"<[^>]*>", " ", "".join(cell["parts"]))).split())
        t = cell["table"]
        col = t["col"]
        while (t["row"], col) in t["taken"]:
            col += 1
        for r in range(cell["rows"]):
            for c in range(cell["cols"]):
                t["taken"].add((t["row"] + r, col + c))
                out.append((t["id"], t["row"] + r, col + c, cell["rows"], cell["cols"], text, bool(r or c)))
        t["col"] = col + cell["cols"]

    def end_cell() -> None:
        if stack and stack[-1]["cell"]:
            cell, stack[-1]["cell"] = stack[-1]["cell"], None
            done(cell)

    for m in _CELL.finditer(html):
        if stack and stack[-1]["cell"]:
            stack[-1]["cell"]["parts"].append(html[at : m.start()])
        at = m.end()
        close, name = m[1], m[2].lower()
        if name == "table" and not close:
            stack.append({"id": tables, "row": -1, "col": 0, "taken": set(), "cell": None})
            tables += 1
        elif not stack:
            continue
        elif name == "table":
            end_cell()
            stack.pop()
        elif name == "tr":
            end_cell()
            if not close:
                stack[-1]["row"] += 1
                stack[-1]["col"] = 0
        else:
            end_cell()
            if not close:
                t = stack[-1]
                t["row"] = max(t["row"], 0)
                span = {k.lower(): max(1, min(_MOST[k.lower()], int(v))) for k, v in _SPAN.findall(m[3])}
                t["cell"] = {"table": t, "rows": span.get("row", 1), "cols": span.get("col", 1), "parts": parts.copy()}
    while stack:
        end_cell()
        stack.pop()
    return out
