"""Operator 1: benchmark decontamination.

Test questions and answers are cut into windows of consecutive words. One Aho-Corasick automaton holds
every window, written as its words between single spaces; a document is normalised in the same way and
scanned once. The words that a hit covers are mapped back to offsets of the original text.

The automaton is rebuilt in each Python worker from broadcast windows. Their size has a bound: items are
dealt to blocks of about BLOCK_BYTES of text by a hash of their id. A usual benchmark is one block. A larger
one is written once by block, and a Bloom filter of its windows' hashes (16 MiB at most) tells in one scan of
all texts which may hold a window; each block's automaton then scans those alone, one block being in the
driver and the workers at a time. Rows are numbered, findings united by row, and runs of hit words merged by
their places. The filter only saves work: what it lets pass wrongly the automata find clean.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import Bitmap, bitmap
from .common import WORD_BYTES, held, keep_rows, map_columns, words, written

#: Benchmark text of one automaton; 256 KiB make about 45,000 windows and 100 MB.
BLOCK_BYTES = 1 << 18
#: Factor of the windows' hashes (any odd 64-bit number does).
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def windows(item: bytes | None, size: int) -> list[bytes]:
    """Each `size` consecutive words of an item; fewer words, but not none, are one window."""
    w = words(item or b"")
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


#: A block's key and its broadcast windows.
Block = tuple[str, Broadcast]


def automaton(block: Block) -> ahocorasick.Automaton:
    """The block's automaton, built once for a worker: window -> (characters, item ids)."""
    key, own = block

    def make() -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for window, items in own.value:
            text = f" {window.decode('latin-1')} "
            a.add_word(text, (len(text), items))
        a.make_automaton()
        return a

    return held(key, make)


def scan(text: bytes, found) -> tuple[int, np.ndarray | None, set]:
    """Number of words, which words are hit, and the items that hit them."""
    w = words(text)
    if not w or not len(found):
        return len(w), None, set()
    line = f" {b' '.join(w).decode('latin-1')} "
    hits = [(end - n + 1, end, items) for end, (n, items) in found.iter(line)]
    if not hits:
        return len(w), None, set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, np.searchsorted(spaces, [x[0] for x in hits]), 1)
    np.add.at(change, np.searchsorted(spaces, [x[1] for x in hits]), -1)
    return len(w), np.cumsum(change[:-1]) > 0, {i for x in hits for i in x[2]}


def runs(text: bytes, hit: np.ndarray) -> list[dict]:
    """The runs of hit words by place (first word, word after the last) and as offsets (in characters of
    the original text) from a start to an end."""
    mark = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    last = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [
        {"first": int(f), "after": int(z) + 1, "start": int(chars[starts[f]]), "end": int(chars[ends[z]])}
        for f, z in zip(first, last, strict=True)
    ]


def merged(found: list[dict]) -> list[dict]:
    """Runs of several scans of one text as those of one scan: runs that overlap or touch are one."""
    out: list[dict] = []
    for x in sorted(found, key=lambda x: x["first"]):
        if out and x["first"] <= out[-1]["after"]:
            if x["after"] > out[-1]["after"]:
                out[-1] |= {"after": x["after"], "end": x["end"]}
        else:
            out.append(dict(x))
    return out


RUN = ["first", "after", "start", "end"]
RUNS = f"array<struct<{', '.join(f'{c}: int' for c in RUN)}>>"
SPANS = "array<struct<start: int, end: int>>"
OFFSETS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", OFFSETS)])


def offsets(found: list[dict]) -> list[dict]:
    return [{"start": x["start"], "end": x["end"]} for x in found]


def grams(w: list[bytes], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashes of each k consecutive words) for k from 1 to `most`, as far as there are so many words."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    made = own
    for k in range(1, min(most, len(w)) + 1):
        if k > 1:
            made = made[:-1] * FACTOR + own[k - 1 :]
        yield k, (made ^ (made >> np.uint64(32))) * FACTOR


@dataclass
class Blocks:
    """A benchmark of several blocks: its items, written once by block, and what their windows hash to."""

    items: DataFrame
    count: int
    size: int
    known: Broadcast
    lengths: list[int]

    def __iter__(self) -> Iterator[Block]:
        """Each block in turn; its windows leave the driver and the workers when the next one is asked for."""
        for b in range(self.count):
            block = shared(self.items.where(F.col("block") == b), self.size)
            yield block
            block[1].destroy()

    def near(self) -> Callable[[bytes], bool]:
        """Tells whether a text may hold a window; never false if it does."""
        known, lengths = self.known, frozenset(self.lengths)

        def test(text: bytes) -> bool:
            found = Bitmap(known.value)
            return any(k in lengths and bool(found.has(h).any()) for k, h in grams(words(text), max(lengths, default=0)))

        return test


def shared(items: DataFrame, size: int) -> Block:
    """The broadcast windows of some items (item_id, text)."""
    own = defaultdict(set)
    for row in items.toLocalIterator():
        for x in windows((row.text or "").encode(), size):
            own[x].add(row.item_id)
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(k, sorted(v)) for k, v in own.items()])


def blocks(bench: DataFrame, size: int) -> Block | Blocks:
    """One block where the benchmark is small enough, else several."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) or 1
    if n == 1:
        return shared(items, size)
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n))).repartition("block"))

    def hashes(texts: list) -> list:
        k, h = [], []
        for t in texts:
            w = words(t or b"")
            for n_words, found in grams(w, size):
                if n_words == min(size, len(w)):
                    k += [n_words] * len(found)
                    h += found.view(np.int64).tolist()
        return [k, h]

    made = written(map_columns(items, ["text"], hashes, "k int, h long", pa.schema([("k", pa.int32()), ("h", pa.int64())])).distinct())
    lengths = sorted(r.k for r in made.select("k").distinct().collect())
    known = bench.sparkSession.sparkContext.broadcast(bitmap(made.select("h")))
    return Blocks(items, n, size, known, lengths)


def contamination(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, n_hit, items (sorted ids, as strings) and spans
    (offsets of the hit passages in the text), against bench (item_id, text).

    A null or empty text has no words and no hit; an item with a null id is left out and one whose text
    is null has no windows; repeated items count once; each row gives one row, whatever its doc_id and
    however large the benchmark. An empty benchmark hits nothing. Further columns are ignored.
    """
    own = blocks(bench, size)
    if isinstance(own, Blocks):
        return united(docs, own)

    def run(ids: list, texts: list) -> list:
        found, out = automaton(own), ([], [], [], [], [])
        for i, t in zip(ids, texts, strict=True):
            n, hit, items = scan(t or b"", found)
            row = (i, n, int(hit.sum()) if hit is not None else 0, sorted(items), offsets(runs(t, hit)) if items else [])
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return list(out)

    return map_columns(docs, ["doc_id", "text"], run, FOUND, FOUND_ARROW)


def clean(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs that hold no window of bench, with all their columns. What is hit is defined as in
    contamination(): null and empty texts stay, repeated rows and ids are judged each by its own text.

    Of several blocks, each is a pass over what the former ones left of the rows that may hold a window at all.
    """

    def without(df: DataFrame, block: Block) -> DataFrame:
        return keep_rows(df, "text", lambda texts: [scan(t or b"", automaton(block))[1] is None for t in texts])

    own = blocks(bench, size)
    if not isinstance(own, Blocks):
        return without(docs, own)
    near = own.near()
    far = keep_rows(docs, "text", lambda texts: [not near(t or b"") for t in texts])
    left = keep_rows(docs, "text", lambda texts: [near(t or b"") for t in texts])
    for block in own:
        left = written(without(left, block))
    return far.unionByName(left)


def united(docs: DataFrame, own: Blocks) -> DataFrame:
    """The findings of several blocks, one row for each row of docs: words hit by more than one of them
    count once. Only texts that may hold a window are scanned by the blocks."""
    near = own.near()

    def first(numbers: list, ids: list, texts: list) -> list:
        return [numbers, ids, [len(words(t or b"")) for t in texts], [t if t and near(t) else None for t in texts]]

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = written(map_columns(
        rows, ["row", "doc_id", "text"], first, "row long, doc_id long, n_words long, text string",
        pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())]),
    ))

    def over(block: Block) -> DataFrame:
        def run(numbers: list, texts: list) -> list:
            found, out = automaton(block), ([], [], [])
            for r, t in zip(numbers, texts, strict=True):
                _, hit, items = scan(t, found)
                if items:
                    for column, v in zip(out, (r, sorted(items), runs(t, hit)), strict=True):
                        column.append(v)
            return list(out)

        return map_columns(
            rows.where("text is not null"), ["row", "text"], run, f"row long, items array<string>, runs {RUNS}",
            pa.schema([("row", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.struct([(c, pa.int32()) for c in RUN])))]),
        )

    found = reduce(DataFrame.unionByName, [written(over(block)) for block in own])
    found = found.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("runs")).alias("runs"),
    )

    def unite(ids: list, n: list, items: list, found_: list) -> list:
        one = [merged(x or []) for x in found_]
        return [ids, n, [sum(x["after"] - x["first"] for x in r) for r in one], [x or [] for x in items], [offsets(r) for r in one]]

    every = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    return map_columns(every, ["doc_id", "n_words", "items", "runs"], unite, FOUND, FOUND_ARROW)


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute(text: str | None, items: dict[str, str | None], size: int = 10) -> tuple[int, int, list[str]]:
    """The same for one text by comparing every place with every window; for tests."""
    w, hit, found = words((text or "").encode()), set(), set()
    for item, t in items.items():
        for x in windows((t or "").encode(), size):
            y = x.split()
            for i in range(len(w) - len(y) + 1):
                if w[i : i + len(y)] == y:
                    hit |= set(range(i, i + len(y)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
