"""Operator 10: byte strings that occur more than once, by column-wise suffix sorting of a collection.

The named method inserts one symbol of every document in each round and keeps the order of all suffixes
(the collection's Burrows-Wheeler transform) with their common prefixes. Whole documents would need as
many rounds as the longest one has bytes, each a pass over the corpus; so the collection is first cut down
to short, aligned contexts, whose columns are then inserted the same way:

1. Every string of `least` bytes has an anchor, its leftmost k-byte word of least hash. Equal strings have
   equal anchors at equal places, so a string's only possible partners are contexts of the same anchor; and
   equal strings of `length` bytes begin with equal strings of `least` bytes. A context is an occurrence of
   an anchor with the strings that it anchors and what follows them up to `length` bytes. One scan emits
   its two hashes and its place; equal texts of a batch are scanned once and counted.
2. Rows come together by anchor. Contexts that are equal as a whole are repeated as a whole and need no
   bytes. Where an anchor has different contexts, those that are unique, and one of each other kind, have
   their bytes fetched, once for each distinct text.
3. The fetched contexts of an anchor are a collection of strings aligned at the anchor. From the last
   column to the first, each round inserts one symbol of every context: a stable distribution by symbol
   updates the order of the suffixes that begin there, and range minima update the common prefixes. A
   suffix whose common prefix with a neighbour reaches `length` (or `least`) begins a repeated string.
   Spark's sorted shuffle files take the place of the sequential external files; many anchors share one
   round. Only order and prefixes are kept, and only within a task.
4. An anchor of more than MANY contexts (a frequent line with other text around it) isn't sorted in one
   task: each of its strings becomes a row with a 128-bit hash, equal ones of a batch become one, and rows
   are dealt out by that hash. Anchors that a sample shows to be frequent have their contexts dealt out by
   the context's hash from the start.
5. The starts of repeated strings of each text come together. The bytes of strings of `length` are removed;
   those of strings of `least` bytes are counted.

Hashes of k-byte words only choose partners; the columns compare bytes. Step 2 takes contexts of one
anchor to be equal if their 64-bit hashes are (with the anchor's, 128 bits), step 4 strings by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_columns, parts, release, written

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are scanned at once, and the bits of a place within them.
BUFFER, PLACE_BITS = 1 << 20, 22
#: Contexts whose columns are inserted together, and the most of one anchor.
TOGETHER, MANY = 8_192, 20_000
#: Of one text in SAMPLE, anchors that stand OFTEN are taken to be frequent, MOST_FREQUENT of them at most.
SAMPLE, OFTEN, MOST_FREQUENT = 1_000, 16, 5_000
#: Other values of the bytes, for a second hash.
OTHER = np.random.default_rng(10_03).permutation(256).astype(np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n at least."""
    own = held("powers", dict)
    if len(own.get("up", ())) <= n:
        one, size = np.ones(1, np.uint64), 1 << max(16, (n + 1).bit_length())
        own["up"], own["down"] = (np.concatenate([one, np.full(size, x, np.uint64)]).cumprod() for x in (BASE, INVERSE))
    return own["up"], own["down"]


def word_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each place."""
    n = len(b)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def contexts(pieces: list[tuple[bytes, int, int]], length: int, least: int, k: int) -> Iterator[tuple]:
    """(piece, anchor hash, context hash, place of the anchor, and relative to it the first and last start
    and the end of the bytes).

    A piece is (text, first start, end of starts): the strings of `least` bytes that begin there.
    """
    taken = [t[a : e - 1 + length] for t, a, e in pieces]
    data = b"".join(taken)
    size, starts_ = np.array([len(x) for x in taken]), np.array([e - a for _, a, e in pieces])
    begin = np.cumsum(size) - size
    h = word_hashes(np.frombuffer(data, np.uint8), k)
    low = np.uint64((1 << PLACE_BITS) - 1)
    smallest = sliding_minimum(h & ~low | np.arange(len(h), dtype=np.uint64), least - k + 1)
    anchor = (smallest & low).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + starts_, -1)
    live = np.cumsum(valid[:-1]) > 0
    fresh = np.concatenate(([True], anchor[1:] != anchor[:-1])) | ~live
    fresh[begin] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(anchor))
    keep = live[starts]
    starts, ends = starts[keep], ends[keep]
    piece = np.searchsorted(begin, starts, side="right") - 1
    ends = np.minimum(ends, (begin + starts_)[piece]) - 1
    stop = np.minimum(ends + length, (begin + size)[piece])
    place = anchor[starts]
    first = np.array([a for _, a, _ in pieces])[piece] - begin[piece]
    for p, ah, at, s, e, z, off in zip(piece.tolist(), h[place].view(np.int64).tolist(), place.tolist(), starts.tolist(), ends.tolist(), stop.tolist(), first.tolist(), strict=True):
        ch = xxhash.xxh3_64_intdigest(data[s:z], (at - s) << 20 | e - s)
        yield p, ah, ch - (1 << 64) if ch >> 63 else ch, at + off, s - at, e - at, z - at


PLACE = [("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("end", pa.int32())]
PLACE_SQL = "pos long, lo int, hi int, end int"
OCCURRENCES = pa.schema([("ah", pa.int64()), ("ch", pa.int64()), ("key", pa.binary()), *PLACE, ("n", pa.int32()), ("known", pa.bool_())])


def once(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[int]]:
    """The first row of each key (column 0), and how many rows have it."""
    first: dict[bytes, int] = {}
    rows, n = [], []
    for i, key in enumerate(batch.column(0).to_pylist()):
        at = first.setdefault(key, len(n))
        if at == len(n):
            rows.append(i)
            n.append(0)
        n[at] += 1
    return (batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))), n


def occurrences(docs: DataFrame, length: int, least: int, k: int) -> DataFrame:
    """The contexts of docs (key, text). Contexts that a chunk of rows holds several times are known to be
    repeated; one row of them has their number n and goes to the others of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole, n = once(whole)
            counts = iter(n)
            for batch in parts(whole):
                keys, texts = (batch.column(i).cast(pa.binary()).to_pylist() for i in range(2))
                many = [next(counts) for _ in keys]
                wait, owner, total = [], [], 0

                def out() -> pa.RecordBatch:
                    rows = [(ah, ch, keys[o := owner[p]], at, lo, hi, end, many[o]) for p, ah, ch, at, lo, hi, end in contexts(wait, length, least, k)]
                    several = Counter()
                    for x in rows:
                        several[x[0], x[1]] += x[-1]
                    seen, goes, known = set(), [], []
                    for x in rows:
                        c = x[0], x[1]
                        n = several[c]
                        if n > 1:
                            known.append((*x, True))
                        if n == 1 or c not in seen:
                            goes.append((*x[:-1], n, False))
                            seen.add(c)
                    cols = list(zip(*goes, *known, strict=True)) or [[] for _ in OCCURRENCES]
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OCCURRENCES, strict=True)], schema=OCCURRENCES)

                for i, t in enumerate(texts):
                    for a in range(0, len(t) - least + 1, BUFFER):
                        e = min(a + BUFFER, len(t) - least + 1)
                        wait.append((t, a, e))
                        owner.append(i)
                        total += e - a + length
                        if total >= BUFFER:
                            yield out()
                            wait, owner, total = [], [], 0
                if wait:
                    yield out()
        release()

    return docs.select("key", "text").mapInArrow(run, f"ah long, ch long, key binary, {PLACE_SQL}, n int, known boolean")


SORTED = pa.schema([("need", pa.bool_()), ("single", pa.bool_()), ("hot", pa.bool_()), ("ah", pa.int64()), ("key", pa.binary()), *PLACE])


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def sort_out(t: pa.Table, hot: bool, frequent: np.ndarray) -> pa.RecordBatch:
    """Of whole anchors (hot, or a frequent one: of whole contexts of an anchor), sorted by anchor and
    context hash: rows of repeated contexts (need false), and the contexts whose bytes are needed (need
    true; single: unique)."""
    ah, ch, n = (t.column(c).to_numpy() for c in ("ah", "ch", "n"))
    new = np.zeros(len(ah), bool)
    new[_runs(ah)] = True
    new[_runs(ch)] = True
    classes = np.flatnonzero(new)
    size, rows = np.add.reduceat(n, classes), np.diff(np.append(classes, len(ah)))
    group = np.searchsorted(_runs(ah), classes, side="right") - 1
    kinds, singles = np.bincount(group), np.bincount(group, weights=size == 1)
    dealt = np.isin(ah[classes], frequent) | hot
    fetch = ((kinds > 1) & (singles > 0))[group] | dealt
    repeated = np.flatnonzero(np.repeat(size > 1, rows))
    needed = classes[fetch]
    index = pa.array(np.concatenate([repeated, needed]))
    none = np.zeros(len(repeated), bool)
    single, hot_ = np.concatenate([none, (size == 1)[fetch]]), np.concatenate([none, dealt[fetch]])
    need = np.arange(len(index)) >= len(repeated)
    own = t.select(SORTED.names[3:]).take(index).combine_chunks().columns
    return pa.RecordBatch.from_arrays([pa.array(need), pa.array(single), pa.array(hot_), *(c.combine_chunks() for c in own)], schema=SORTED)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Tables of whole runs of a column by which the rows are sorted, of about `least` rows."""
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        if sum(b.num_rows for b in wait) < least:
            continue
        t = pa.Table.from_batches(wait)
        x = t.column(column).to_numpy()
        if x[0] != x[-1]:
            end = int(np.flatnonzero(x != x[-1])[-1]) + 1
            yield t.slice(0, end)
            wait = t.slice(end).combine_chunks().to_batches()
    if wait:
        yield pa.Table.from_batches(wait)


def frequent_anchors(docs: DataFrame, length: int, least: int, k: int) -> list[int]:
    """Anchors that stand often in a thousandth of the texts (chosen by hash), the MOST_FREQUENT at most.

    They only decide how rows are dealt out: contexts of these anchors go by their own hash as well.
    """
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)
    seen = occurrences(some, length, least, k).where("not known").groupBy("ah").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return sorted(r.ah for r in seen.orderBy(F.desc("n"), "ah").limit(MOST_FREQUENT).collect())


def sorted_out(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and context hash, but for those known to be repeated. About MANY wait: of
    whole anchors, or of one anchor alone."""
    wait: list[pa.RecordBatch] = []
    hot = None  # the anchor that is too large
    for batch in batches:
        known = batch.column("known")
        if pc.any(known).as_py():
            own = batch.filter(known)
            no = pa.array(np.zeros(own.num_rows, bool))
            yield pa.RecordBatch.from_arrays([no, no, no, *own.select(SORTED.names[3:]).columns], schema=SORTED)
            batch = batch.filter(pc.invert(known))
        for at in range(0, batch.num_rows, MANY):
            wait.append(batch.slice(at, MANY))
            if sum(b.num_rows for b in wait) < MANY:
                continue
            t = pa.Table.from_batches(wait).combine_chunks()
            ah, ch = t.column("ah").to_numpy(), t.column("ch").to_numpy()
            end = 0
            if ah[0] == ah[-1]:
                hot = int(ah[0])
                if ch[0] != ch[-1]:
                    end = int(np.flatnonzero(ch != ch[-1])[-1]) + 1
                else:  # one context: all its rows are repeated, and the last one goes on to say so
                    yield sort_out(t.slice(0, len(ah) - 1), False, frequent)
                    last = t.slice(len(ah) - 1).set_column(t.column_names.index("n"), OCCURRENCES.field("n"), pa.array([2], pa.int32()))
                    wait = last.combine_chunks().to_batches()
                    continue
            else:
                end = int(np.flatnonzero(ah != ah[-1])[-1]) + 1
                first = int(np.flatnonzero(ah != ah[0])[0]) if hot == ah[0] else 0
                if first:
                    yield sort_out(t.slice(0, first), True, frequent)
                if end > first:
                    yield sort_out(t.slice(first, end - first), False, frequent)
                wait = t.slice(end).combine_chunks().to_batches()
                continue
            yield sort_out(t.slice(0, end), True, frequent)
            wait = t.slice(end).combine_chunks().to_batches()
    if wait:
        t = pa.Table.from_batches(wait)
        ah = t.column("ah").to_numpy()
        first = int(np.count_nonzero(ah == hot)) if hot is not None else 0
        if first:
            yield sort_out(t.slice(0, first), True, frequent)
        if first < len(ah):
            yield sort_out(t.slice(first), False, frequent)
    release()


FETCHED = pa.schema([("ah", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()), ("key", pa.binary()), *PLACE, ("own", pa.binary())])


def fetched(needs: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of the needed contexts: (ah, single, hot, key, pos, lo, hi, end, own)."""
    by_text = needs.groupBy("key").agg(F.collect_list(F.struct("ah", "single", "hot", "pos", "lo", "hi", "end")).alias("at"))
    texts = docs.groupBy("key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in parts(b)):
            keys, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("key", "text"))
            at = batch.column("at")
            f = at.flatten()
            ah, single, hot, pos, lo, hi, end = (f.field(i) for i in range(7))
            row = np.repeat(np.arange(len(keys)), np.diff(at.offsets.to_numpy())).tolist()
            own = [texts[r][p + a : p + z] for r, p, a, z in zip(row, pos.to_pylist(), lo.to_pylist(), end.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ah, single, hot, pa.array([keys[r] for r in row], pa.binary()), pos, lo, hi, end, pa.array(own, pa.binary())], schema=FETCHED)
        release()

    joined = texts.join(by_text, "key").select("key", "text", "at")
    return joined.mapInArrow(run, f"ah long, single boolean, hot boolean, key binary, {PLACE_SQL}, own binary")


def insert_columns(group: np.ndarray, own: list[bytes], lo: np.ndarray, hi: np.ndarray, lengths: tuple[int, ...], reach: int) -> list[np.ndarray]:
    """For each of the lengths (contexts x starts from -reach to 0): whether the string that begins there
    occurs in another context of the group (groups are runs of equal numbers)."""
    n, width = len(own), reach + max(lengths)
    symbol = np.full((width, n), -1, np.int16)  # by column; -1: outside the context, equal to nothing
    for i, (b, a) in enumerate(zip(own, (lo + reach).tolist(), strict=True)):
        symbol[a : a + len(b), i] = np.frombuffer(b, np.uint8)
    number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))).astype(np.int64) << 16
    order, prefix = np.arange(n), np.zeros(n, np.int64)
    found = [np.zeros((reach + 1, n), bool) for _ in lengths]
    for column in range(width - 1, -1, -1):
        key = (number + symbol[column])[order]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = (key[1:] == key[:-1]) & (symbol[column][order[by[1:]]] >= 0)
        after = np.flatnonzero(same) + 1
        # The common prefix of two suffixes that meet is the least one between them in the old order.
        bounds = np.empty(2 * len(after), np.int64)
        bounds[::2], bounds[1::2] = by[after - 1] + 1, by[after] + 1
        met = np.zeros(n, np.int64)
        if len(after):
            met[after] = 1 + np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
        order, prefix = order[by], met
        if column <= reach:
            for length, f in zip(lengths, found, strict=True):
                long = prefix >= length
                long[:-1] |= long[1:]
                f[column, order] = long
    starts = np.arange(-reach, 1)[:, None]
    return [(f & (starts >= lo) & (starts <= hi)).T for f in found]


STARTS = pa.schema([("key", pa.binary()), ("size", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])
STARTS_SQL = "key binary, size int, first long, last long"


def compared(contexts_: DataFrame, lengths: tuple[int, ...], reach: int) -> DataFrame:
    """(key, size, first, last): runs of starts of repeated strings of that size among the unique contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "ah", TOGETHER):
            ah, single, pos, lo, hi = (t.column(c).to_numpy() for c in ("ah", "single", "pos", "lo", "hi"))
            own = t.column("key").combine_chunks()
            for size, found in zip(lengths, insert_columns(ah, t.column("own").to_pylist(), lo, hi, lengths, reach), strict=True):
                edge = np.diff((found & single[:, None]).astype(np.int8), axis=1, prepend=0, append=0)
                row, a = np.nonzero(edge == 1)
                _, b = np.nonzero(edge == -1)
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(row)), pa.array(np.full(len(row), size, np.int32)), pa.array(pos[row] + a - reach), pa.array(pos[row] + b - 1 - reach)], schema=STARTS)
        release()

    n = int(contexts_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts_.repartition(n, "ah").sortWithinPartitions("ah").mapInArrow(run, STARTS_SQL)


STRINGS = pa.schema([("known", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("single", pa.bool_()), ("n", pa.int32()), *((f.name, f.type) for f in STARTS)])


def strings(contexts_: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Every string of some contexts: its 128-bit hash (a, b), place, whether its context is unique. Equal
    strings of a batch become one row (n: how many), and those of unique contexts are known to be repeated;
    they come as runs of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                own = part.column("own").to_pylist()
                single, pos, lo, hi = (part.column(c).to_numpy(zero_copy_only=False) for c in ("single", "pos", "lo", "hi"))
                data = np.frombuffer(b"".join(own), np.uint8)
                bytes_ = np.array([len(x) for x in own])
                begin = np.cumsum(bytes_) - bytes_
                for size in lengths:
                    if len(data) < size:
                        continue
                    many = np.maximum(np.minimum(hi - lo + 1, bytes_ - size + 1), 0)
                    row = np.repeat(np.arange(len(own)), many)
                    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    place = begin[row] + offset
                    a, b = (word_hashes(x, size)[place] for x in (data, OTHER[data]))
                    order = np.lexsort((b, a))
                    a, b, row, offset = a[order], b[order], row[order], offset[order]
                    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
                    run_of = np.cumsum(new) - 1
                    count = np.bincount(run_of) if len(a) else np.zeros(0, np.int64)
                    known = np.flatnonzero((count[run_of] > 1) & single[row])
                    start = pos[row] + lo[row] + offset
                    known = known[np.lexsort((start[known], row[known]))]
                    begins = np.ones(len(known), bool)
                    begins[1:] = (row[known[1:]] != row[known[:-1]]) | (start[known[1:]] != start[known[:-1]] + 1)
                    from_ = np.flatnonzero(begins)
                    to = np.append(from_[1:], len(known))[: len(from_)] - 1
                    index, nothing = np.flatnonzero(new), np.zeros(len(from_), np.int64)
                    rows = np.concatenate([row[known[from_]], row[index]])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(len(rows)) < len(from_)), *(pa.array(np.concatenate([nothing, x[index].view(np.int64)])) for x in (a, b)), pa.array(single[rows]),
                        pa.array(np.concatenate([nothing, count[run_of[index]]]).astype(np.int32)), part.column("key").take(pa.array(rows)), pa.array(np.full(len(rows), size, np.int32)),
                        pa.array(np.concatenate([start[known[from_]], start[index]])), pa.array(np.concatenate([start[known[to]], start[index]])),
                    ], schema=STRINGS)
        release()

    return contexts_.mapInArrow(run, f"known boolean, a long, b long, single boolean, n int, {STARTS_SQL}")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of strings sorted by size, a and b -> starts of those that are repeated. A row waits for the next."""
    wait = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if wait is None else [wait, batch]).combine_chunks()
        size, a, b, n, single = (t.column(c).to_numpy() for c in ("size", "a", "b", "n", "single"))
        same = (size[1:] == size[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = n > 1
        twice[1:] |= same
        twice[:-1] |= same
        keep = np.flatnonzero(twice & single)
        out = t.take(pa.array(keep)).select(STARTS.names).combine_chunks()
        yield from out.cast(STARTS).to_batches()
        last = t.slice(len(a) - 1)  # seen again with the next batch; twice at most, and sets forget that
        wait = last.combine_chunks().to_batches()[0]
    release()


def of_hot_anchors(contexts_: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(key, size, first, last) as compared() gives it, however many contexts an anchor has."""
    found = written(strings(contexts_, lengths))
    n = int(contexts_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.where("not known").repartition(n, "a", "b").sortWithinPartitions("size", "a", "b")
    return found.where("known").select(*STARTS.names).unionByName(dealt.mapInArrow(_repeated, STARTS_SQL))


def removed(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left, the number of removed bytes, and the removed spans (from a byte to an end)."""
    spans: list[list[int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + length)
        else:
            spans.append([a, b + length])
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), sum(b - a for a, b in spans), [(a, b) for a, b in spans]


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 32, keep_text: bool = False, least: int = 256) -> DataFrame:
    """For each row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, n_repeated; with
    keep_text also the bytes left (binary) and the removed spans (array of struct: start, end).

    Every byte is removed that a string of `length` bytes covers which also begins elsewhere in any row.
    n_repeated counts the bytes that strings of only `least` bytes cover so; they stay. Rows are told apart
    by their texts only: a text that two rows hold is repeated as a whole if it has `length` bytes. Null
    counts as empty; repeated ids and rows are fine; an empty table gives an empty one; further columns are
    ignored. Long texts are scanned in overlapping parts.
    """
    least = min(least, length)
    lengths, reach = tuple(sorted({length, least}, reverse=True)), least - k
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = own.where(F.octet_length("text") >= least)
    rows = occurrences(enough, length, least, k)
    often = frequent_anchors(enough, length, least, k)
    frequent, deal = np.array(often, np.int64), F.when(F.col("known"), F.xxhash64("key", "pos"))
    if often:
        deal = deal.when(F.col("ah").isin(often), F.xxhash64("ah", "ch"))
    deal = deal.otherwise(F.col("ah"))
    out = written(
        rows.repartition(n, deal).sortWithinPartitions("ah", "ch")
        .mapInArrow(lambda batches: sorted_out(batches, frequent), f"need boolean, single boolean, hot boolean, ah long, key binary, {PLACE_SQL}")
    )
    first = F.col("pos") + F.col("lo")
    whole = out.where("not need").select(
        "key", first.alias("first"), (F.col("pos") + F.col("hi")).alias("last"),
        F.least(F.col("pos") + F.col("hi"), F.col("pos") + F.col("end") - length).alias("last_long"),
    )
    runs = whole.select("key", F.lit(least).alias("size"), "first", "last")
    if least < length:
        runs = runs.unionByName(whole.where("last_long >= first").select("key", F.lit(length).alias("size"), "first", F.col("last_long").alias("last")))
    needed = out.where("need")
    if out.where("hot").isEmpty():
        runs = runs.unionByName(compared(fetched(needed, enough), lengths, reach))
    else:
        bytes_ = written(fetched(needed, enough))
        runs = runs.unionByName(compared(bytes_.where("not hot"), lengths, reach)).unionByName(of_hot_anchors(bytes_.where("hot"), lengths))
    runs = runs.groupBy("key").agg(F.collect_set(F.struct("size", "first", "last")).alias("runs"))

    def run(ids: list, texts: list, found: list) -> list:
        made = []
        for i, t, r in zip(ids, texts, found, strict=True):
            left, n, spans = removed(t, [(x["first"], x["last"]) for x in r or [] if x["size"] == length], length)
            repeated = removed(t, [(x["first"], x["last"]) for x in r or [] if x["size"] == least], least)[1]
            row = (i, len(t), n, len(spans), hashlib.sha256(left).hexdigest(), repeated)
            made.append((*row, left, [{"start": a, "end": b} for a, b in spans]) if keep_text else row)
        return list(zip(*made, strict=True))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())]
    if keep_text:
        schema += ", kept binary, spans array<struct<start: long, end: long>>"
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return map_columns(own.join(runs, "key", "left"), ["doc_id", "text", "runs"], run, schema, pa.schema(fields))


def brute(texts: list[bytes], length: int) -> list[bytes]:
    """What is left of each text, by counting every string; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    return [
        removed(t, [(i, i) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1], length)[0] for t in texts
    ]
