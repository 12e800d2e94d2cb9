"""Operator 9: paragraphs that repeat or nearly repeat, by MinHash banding.

Two kinds of paragraphs are compared, each with its own kind:

* lines of `least_words` words or more;
* pieces of the whole text, for passages that begin or end within a line: the words are cut where the hash
  of two neighbouring words is the least within REACH words on either side, so equal passages are cut at
  the same places whatever stands around them (17 words on average, 9 at least).

Equal paragraphs are one class, named by a 128-bit hash of their words. Classes of lines are banded by the
MinHash of their five-word shingles, and those that share a band collide. Colliding classes have their sets
of shingles fetched and their Jaccard similarity is checked exactly. Links go to connected components; of
each component the first paragraph stays (by doc_id, then text, then place). Repeated pieces that stand side
by side are a passage if they have `least_words` words together; single pieces, such as frequent short
lines, aren't.

Fourteen bands of five rows: similarity 0.8 collides with probability 1 - (1 - 0.8**5)**14 = 0.996, 0.9 with
0.999998, 0.4 with 0.13. Pieces aren't banded, as there equal and similar are nearly the same: a changed word
costs five shingles on either side, so similarity 0.8 takes 49 words, and fewer can only differ at an end.

In a bucket of FEW classes or fewer all are checked against its first. In a larger one a class leads, the one that is in
most large buckets (what others are copies of shares more bands with them than they do with each other), and
every class is checked against it; those unlike it choose a leader again and are checked against that one,
and so on until a round links under a tenth of what is left. Those classes are then dealt out anew by bands of
AGAIN_ROWS fresh hashes, what is then in buckets of over MANY classes by bands of STEP more, and so on until no
bucket is so large; in the others the sketches of all pairs are compared, 256 one-bit MinHashes of which AGREE
must be equal (at similarity 0.8 they are but for four standard deviations), before sets are fetched. Each
time there are as many bands as similarity 0.8 needs to collide with probability 1 - exp(-3.5) = 0.97. Buckets
of less similar classes shrink with every hash, faster than the bands grow in number: n classes that have
similarity s to what they were all made from go on until n * s**rows is MANY, by (n / MANY)**e bands each,
e = log(0.8) / log(s). Rows of a frequent
band are thinned to one where they are made, so no task gets a whole bucket.

Bands and leaders miss some links. So each line's smallest shingles by hash, a fifth and one, are its prefix: two
lines of similarity 0.8 share a shingle of their prefixes, whatever the order (prefix filtering, exact). A shingle
whose classes the links so far leave in several components is open. Classes of open ones of FEW classes or fewer
meet there; those of more frequent ones get prefixes by a second order, frequent shingles last, and meet by these,
by blocks of BLOCK. Where classes meet, pairs of different components are compared by sizes, places and parities:
a parity tells of each of BITS parts of all hashes whether a set has an odd number there, so two sets differ in as
many shingles at least as their parities in bits, and at similarity 0.8 in a ninth of both sizes together at most
(exact too). No pair leaves the task: classes that may have a partner meet once more with their sets, and of each
meeting come the links that join its components, fewer than its classes. So components are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, dropped, map_columns, parts, release, words, written
from .components import components
from .repeated_bytes import powers, sliding_minimum

SHINGLE, BANDS, ROWS = 5, 14, 5
#: Classes of a bucket that is dealt out anew whose sketches are all compared.
MANY = 512
#: Rows of the bands by which large buckets are dealt out anew, and by how many they grow each time.
AGAIN_ROWS, STEP = 10, 5
#: Bits of a sketch, and how many of them agree in pairs that are checked: 0.9 at similarity 0.8, less four
#: standard deviations.
SKETCH, AGREE = 256, 211
#: Words on either side of a cut; classes of a bucket that are checked against its first; see `cuts`.
REACH, FEW = 8, 16
#: Classes of a frequent shingle that are compared with all others of it at a time; bits of a parity.
BLOCK, BITS = 1024, 256
#: Frequent shingles that are sent to all tasks with their counts.
MOST = 1 << 20
RUN = 16
#: Words that are hashed at once; a single longer text comes alone.
CHUNK = 200_000
NONE = np.iinfo(np.uint64).max
#: Multipliers of word positions within a shingle and of the signature's rows (any odd 64-bit numbers do).
_draw = np.random.default_rng(20_09)
PLACES = _draw.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
SALTS = _draw.integers(0, 1 << 63, 4, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of a run of words' hashes, repeats included."""
    n = max(0, len(h) - SHINGLE + 1)
    return mixed(sum(h[k : k + n] * PLACES[k] for k in range(SHINGLE)))


def cuts(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of some texts start; `begin`: where the texts do (each has a word at least). And which
    part of a run of one word each piece begins, from 1, or 0."""
    pair = np.full(len(h), NONE, np.uint64)
    pair[:-1] = mixed(h[:-1] * SALTS[0] + h[1:])
    pair[begin[1:] - 1] = pair[-1] = NONE  # no pair across texts
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    at = np.arange(len(h)) + REACH * (of + 1)
    wide = np.full(len(h) + REACH * (len(begin) + 1), NONE, np.uint64)
    wide[at] = pair
    near = sliding_minimum(wide, REACH)
    least = (pair < near[at - REACH]) & (pair <= near[at + 1])
    least[begin] = True
    # A word that is repeated over and over has no least pair: cut such a run every RUN words from its begin.
    # These pieces are told apart by their numbers, so a run is a repeat of other runs and not of itself.
    here = np.arange(len(h))
    same = np.zeros(len(h), bool)
    same[1:] = (pair[1:] == pair[:-1]) & (pair[1:] != NONE)
    first = np.maximum.accumulate(np.where(same, 0, here))
    run = same & ((here - first) % RUN == 0)
    least |= run
    nth = np.where(run, (here - first) // RUN + 1, 0)
    least[first[run]], nth[first[run]] = True, 1
    at = np.flatnonzero(least)
    return at, nth[at]


class Units:
    """The paragraphs of some texts: of which text, whether a line, first word within the text, words,
    first word within `h`, which has the hashes of all words. Without pieces: lines alone."""

    def __init__(self, texts: list[bytes], least_words: int, pieces: bool = True):
        all_words, begin, lines = [], [], []
        for i, t in enumerate(texts):
            start = len(all_words)
            for line in t.split(b"\n"):
                w = words(line)
                if len(w) >= least_words:
                    lines.append((i, len(all_words) - start, len(w), len(all_words)))
                all_words += w
            begin.append(start)
        self.h = word_hashes(all_words)
        begin_, end = np.array(begin, np.int64), np.array([*begin[1:], len(all_words)], np.int64)
        full = (end > begin_) & pieces
        owner = np.flatnonzero(full)
        start, nth = cuts(self.h, begin_[full]) if len(owner) else np.zeros((2, 0), np.int64)
        size = np.diff(np.append(start, len(self.h))) if len(owner) else start
        text = owner[np.searchsorted(begin_[full], start, side="right") - 1] if len(owner) else start
        keep = size >= SHINGLE
        start, size, text, nth = start[keep], size[keep], text[keep], nth[keep]
        own = np.array(lines, np.int64).reshape(-1, 4)
        self.text = np.concatenate([own[:, 0], text])
        self.line = np.arange(len(self.text)) < len(own)
        self.first = np.concatenate([own[:, 1], start - begin_[text]])
        self.size = np.concatenate([own[:, 2], size])
        self.start = np.concatenate([own[:, 3], start])
        self.nth = np.concatenate([np.zeros(len(own), np.int64), nth])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each paragraph's words and kind."""
        up, down = powers(len(self.h))
        out = []
        for salt in SALTS[1:3]:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.h + salt) * up[: len(self.h)])])
            own = (sums[self.start + self.size] - sums[self.start]) * down[self.start]
            kind = self.line.astype(np.uint64) * SALTS[3] + self.nth.astype(np.uint64) * SALTS[0]
            out.append(mixed(mixed(own + self.size.astype(np.uint64)) + kind).view(np.int64))
        return out[0], out[1]

    def bands(self) -> Iterator[np.ndarray]:
        """Of each band, the hashes of the lines (they are the first paragraphs)."""
        lines = int(self.line.sum())
        if not lines:
            return
        made = shingles(self.h)
        bounds = np.empty(2 * lines, np.int64)
        bounds[::2], bounds[1::2] = self.start[:lines], (self.start + self.size)[:lines] - SHINGLE + 1
        v = np.full(len(made) + 1, NONE, np.uint64)
        for band in range(BANDS):
            out = np.full(lines, band + 1, np.uint64)
            for row in range(band * ROWS, (band + 1) * ROWS):
                np.multiply(made, FACTORS[row], out=v[:-1])
                v[:-1] += SHIFTS[row]
                out = mixed(out + np.minimum.reduceat(v, bounds)[::2])
            yield out.view(np.int64)

    def prefixes(self, least: float) -> tuple[np.ndarray, pa.Array]:
        """Of each line, the number of its distinct shingles and the smallest ones, as many as two lines of
        similarity `least` share one of."""
        lines = int(self.line.sum())
        count = np.maximum(self.size[:lines] - SHINGLE + 1, 0)
        owner = np.repeat(np.arange(lines), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        own = shingles(self.h)[np.repeat(self.start[:lines], count) + within]
        order = np.lexsort((own, owner))
        owner, own = owner[order], own[order]
        once = _starts(owner, own) if len(own) else np.zeros(0, np.int64)
        owner, own = owner[once], own[once]
        n = np.bincount(owner, minlength=lines)
        place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        long = np.minimum(n, prefix_length(n, least))
        ends = np.concatenate([[0], np.cumsum(long)])
        return n, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[place < long[owner]].view(np.int64)))


def prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    """How many first shingles of a set of n, in any order, hold one of each set of similarity `least` to it."""
    return n - np.ceil(least * n - 1e-6).astype(np.int64) + 1


def chunks(batches: Iterator[pa.RecordBatch], least_words: int, pieces: bool = True) -> Iterator[tuple[pa.RecordBatch, Units]]:
    """Rows (columns ending with the text) and their paragraphs, some CHUNK words at a time."""
    for batch in (part for b in batches for part in parts(b)):
        texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total < 6 * CHUNK):
                total += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), Units(texts[at:end], least_words, pieces)
            at = end
    release()


FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.bool_()), ("first", pa.int32()), ("size", pa.int32()), ("n1", pa.int64()), ("n2", pa.int64())])
FOUND_SQL = "doc_id long, text_key long, line boolean, first int, size int, n1 long, n2 long"


def paragraphs(docs: DataFrame, least_words: int) -> DataFrame:
    """The paragraphs of each row of docs (doc_id, text_key, text), by name (n1, n2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, u in chunks(batches, least_words):
            row = pa.array(u.text)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), batch.column(1).take(row), pa.array(u.line), pa.array(u.first.astype(np.int32)), pa.array(u.size.astype(np.int32)), *map(pa.array, u.names()),
            ], schema=FOUND)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, FOUND_SQL)


BANDED = pa.schema([("band", pa.int64()), ("name", pa.int64()), ("kind", pa.int64())])
#: Kinds of rows: bands, those that are large, and those of them that stay; of prefixes the number of the line's
#: shingles, times 2**32, and the place.
BAND, LARGE, STAYS = -1, -2, -3


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def banded(docs: DataFrame, least_words: int, least: float) -> DataFrame:
    """(band, name, kind): each band of each line's class, once for each chunk of rows, and each shingle of its
    prefix (as band).

    A band of over FEW classes in a chunk is large: these rows stay, and one of them goes on to the others.
    """

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=BANDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, u in chunks(batches, least_words, pieces=False):
            n1, _ = u.names()
            for band in u.bands():
                name = n1[: len(band)]
                order = np.lexsort((name, band))
                band, name = band[order], name[order]
                once = _starts(band, name)
                band, name = band[once], name[once]
                group = _starts(band)
                size = np.diff(np.append(group, len(band)))
                large = np.repeat(size > FEW, size)
                first = np.zeros(len(band), bool)
                first[group] = True
                goes = np.flatnonzero(~large | first)
                stays = np.flatnonzero(large)
                rows = np.concatenate([goes, stays])
                kind = np.where(np.arange(len(rows)) < len(goes), np.where(large[rows], LARGE, BAND), STAYS)
                yield batch(band[rows], name[rows], kind)
            n, prefix = u.prefixes(least)
            name, once = np.unique(n1[: len(n)], return_index=True)
            prefix = prefix.take(pa.array(once))
            long = np.diff(prefix.offsets.to_numpy())
            place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            yield batch(prefix.flatten().to_numpy(), np.repeat(name, long), (np.repeat(n[once], long) << 32) + place)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "band long, name long, kind long")


CANDIDATES = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("shingles", pa.int32()), ("place", pa.int32())])


def candidates(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows (band, name, kind) sorted by band -> pairs (null, a, b) of the first of small buckets with each other
    one, and the members (bucket, a, null) of large ones, such as all rows that stay. About `most` rows wait. And
    prefixes of several classes (shingle, a, null, shingles, place), some of them twice."""

    def found(t: pa.Table, all_large: bool = False) -> pa.RecordBatch:
        band, name, kind = (t.column(c).to_numpy() for c in ("band", "name", "kind"))
        known = set(band[kind != BAND].tolist())
        order = np.lexsort((name, band))
        band, name = band[order], name[order]
        once = _starts(band, name)
        band, name = band[once], name[once]
        group = _starts(band)
        size = np.diff(np.append(group, len(band)))
        many = (size > FEW) | np.isin(band[group], list(known)) | all_large
        rows = np.flatnonzero(np.repeat(many, size))
        first = np.repeat(name[group], size)
        pair = np.flatnonzero((first != name) & np.repeat(~many, size))
        none = pa.nulls(len(rows) + len(pair), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(band[rows]), pa.nulls(len(pair), pa.int64())]), pa.array(np.concatenate([name[rows], first[pair]])),
            pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(name[pair])]), none, none,
        ], schema=CANDIDATES)

    def shared(t: np.ndarray, last: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        """Prefixes of several classes among columns band, name and kind; those of the last one, which may go on."""
        t = np.concatenate([last, t], 1)
        t = t[:, np.lexsort(t[1::-1])]
        t = t[:, _starts(t[0], t[1])]
        group = _starts(t[0])
        size = np.diff(np.append(group, t.shape[1]))
        last = t[:, group[-1] : group[-1] + 2]  # two suffice to tell that there are several
        t = t[:, np.repeat(size > 1, size)]
        none = pa.nulls(t.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1]), none, pa.array(t[2] >> 32, pa.int32()), pa.array(t[2] & 0xFFFFFFFF, pa.int32())], schema=CANDIDATES), last

    wait: list[pa.RecordBatch] = []
    hot, last = None, np.zeros((3, 0), np.int64)
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind >= 0).any():
            made, last = shared(np.stack([x.to_numpy()[kind >= 0] for x in batch.columns]), last)
            yield made
        if (kind == STAYS).any():
            yield found(pa.Table.from_batches([batch.filter(pa.array(kind == STAYS))]), True)
        batch = batch.filter(pa.array((kind == BAND) | (kind == LARGE)))
        wait += [batch.slice(at, most) for at in range(0, batch.num_rows, most)]
        if sum(x.num_rows for x in wait) < most:
            continue
        t = pa.Table.from_batches(wait).combine_chunks()
        band = t.column("band").to_numpy()
        if band[0] == band[-1]:
            hot = int(band[0])
            yield found(t, True)
            wait = []
            continue
        first = int(np.count_nonzero(band == hot)) if hot is not None else 0
        end = int(np.flatnonzero(band != band[-1])[-1]) + 1
        if first:
            yield found(t.slice(0, first), True)
        if end > first:
            yield found(t.slice(first, end - first))
        wait = t.slice(end).combine_chunks().to_batches()
    if wait:
        t = pa.Table.from_batches(wait)
        band = t.column("band").to_numpy()
        first = int(np.count_nonzero(band == hot)) if hot is not None else 0
        if first:
            yield found(t.slice(0, first), True)
        if first < len(band):
            yield found(t.slice(first))
    release()


def shingle_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(name, own, bits): the distinct shingles, as bytes of sorted 64-bit numbers, of the paragraphs at the given
    places (name, doc_id, text_key, first, size) of docs (doc_id, text_key, text), and their parities."""
    def by_row(df: DataFrame) -> DataFrame:  # keys without nulls, so texts are shuffled once
        return df.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("none", F.col("doc_id").isNull())

    keys = ["id", "none", "text_key"]
    wanted = by_row(places).groupBy(keys).agg(F.collect_list(F.struct("name", "first", "size")).alias("at"))
    texts = by_row(docs).repartition(*keys).groupBy(keys).agg(F.first("text").alias("text"))

    def run(texts_: list, at: list) -> list:
        names, own, bits = [], [], []
        for t, want in zip(texts_, at, strict=True):
            w = words(t or b"")
            for x in want:
                names.append(x["name"])
                own.append(np.unique(shingles(word_hashes(w[x["first"] : x["first"] + x["size"]]))))
                bits.append(parity(own[-1]))
        return [names, [x.tobytes() for x in own], bits]

    return map_columns(texts.join(wanted, keys), ["text", "at"], run, "name long, own binary, bits array<long>", pa.schema([("name", pa.int64()), ("own", pa.binary()), ("bits", pa.list_(pa.int64()))]))


def parity(own: np.ndarray) -> list:
    """Of each of BITS parts of all hashes, whether a set has an odd number there; as longs."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (name, own) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in parts(b)):
            own, other = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("own", "other"))
            keep = pa.array([similar(x, y, least) for x, y in zip(own, other, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep).cast(LINKS)
        release()

    rows = pairs.join(sets.select(F.col("name").alias("a"), "own"), "a").join(sets.select(F.col("name").alias("b"), F.col("own").alias("other")), "b")
    return rows.select("a", "b", "own", "other").mapInArrow(run, "a long, b long")


def minima(own: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The MinHash of a set for each factor and shift, some of them at a time."""
    step = max(1, CHUNK // max(1, len(own)))
    out = [(own * factors[k : k + step, None] + shifts[k : k + step, None]).min(1, initial=NONE) for k in range(0, len(factors), step)]
    return np.concatenate(out)


def drawn(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n factors and shifts."""
    draw = np.random.default_rng([20_09, seed])
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def sketches(sets: DataFrame) -> DataFrame:
    """(name, own, k): sets (name, own) with SKETCH one-bit MinHashes of each, as an array of longs."""
    factors, shifts = drawn(SKETCH, 0)

    def sketch(own: np.ndarray) -> list:
        return np.packbits((mixed(minima(own, factors, shifts)) & np.uint64(1)).astype(bool)).view(np.int64).tolist()

    def run(names: list, own: list) -> list:
        return [names, own, [sketch(np.frombuffer(x, np.uint64)) for x in own]]

    return map_columns(sets, ["name", "own"], run, "name long, own binary, k array<long>", pa.schema([("name", pa.int64()), ("own", pa.binary()), ("k", pa.list_(pa.int64()))]))


def alike(k: str, other: str) -> Column:
    """Whether two sketches agree in AGREE bits."""
    return sum(F.bit_count(F.col(k)[i].bitwiseXOR(F.col(other)[i])) for i in range(SKETCH // 64)) <= SKETCH - AGREE


def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, name, k) sorted by bucket -> pairs (a, b) of a bucket whose sketches agree. The last
    bucket of a batch waits for the next one."""

    def found(bucket: np.ndarray, name: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        group = _starts(bucket)
        size = np.diff(np.append(group, len(bucket)))
        pairs = [np.zeros((2, 0), np.int64)]
        for lag in range(1, min(FEW, int(size.max(initial=1)))):  # small buckets by the distance of rows
            x = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & np.repeat(size <= FEW, size)[lag:])
            x = x[np.bitwise_count(k[x] ^ k[x + lag]).sum(1) <= SKETCH - AGREE]
            pairs.append(np.stack([name[x], name[x + lag]]))
        for g, n in zip(group[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            own = k[g : g + n]
            for x in range(n - 1):
                y = x + 1 + np.flatnonzero(np.bitwise_count(own[x] ^ own[x + 1 :]).sum(1) <= SKETCH - AGREE)
                if len(y):
                    pairs.append(np.stack([np.full(len(y), name[g + x]), name[g + y]]))
        a, b = np.concatenate(pairs, 1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=LINKS)

    wait = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH // 64), np.int64))
    for batch in batches:
        if batch.num_rows:
            own = (*(batch.column(c).to_numpy() for c in ("bucket", "name")), batch.column("k").flatten().to_numpy().reshape(-1, SKETCH // 64))
            wait = tuple(np.concatenate(x) for x in zip(wait, own, strict=True))
            end = int(_starts(wait[0])[-1])
            yield found(*(x[:end] for x in wait))
            wait = tuple(x[end:] for x in wait)
    yield found(*wait)
    release()


def dealt_again(names: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(bucket, name, k): the classes (name) by bands of so many rows, for which both hashes and their number
    are chosen; sets also has their sketches."""
    bands = math.ceil(3.5 / 0.8**rows)
    factors, shifts = drawn(bands * rows, rows)

    def signature(own: np.ndarray) -> list:
        least = minima(own, factors, shifts).reshape(bands, rows)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for row in range(rows):
            out = mixed(out + least[:, row])
        return out.view(np.int64).tolist()

    def run(ids: list, own: list, k: list) -> list:
        return [ids, [signature(np.frombuffer(x, np.uint64)) for x in own], k]

    longs = pa.list_(pa.int64())
    made = map_columns(sets.join(names, "name", "left_semi"), ["name", "own", "k"], run, "name long, buckets array<long>, k array<long>", pa.schema([("name", pa.int64()), ("buckets", longs), ("k", longs)]))
    return made.select(F.explode("buckets").alias("bucket"), "name", "k")


def led(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within large buckets (bucket, name), written: see the module's text."""
    members = members.distinct()
    known = written(sketches(sets.join(members.select("name").distinct(), "name", "left_semi")))
    links, rows = [], AGAIN_ROWS
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        many = members.groupBy("name").agg(F.count(F.lit(1)).alias("many"))
        free = written(members.join(many, "name").join(known.drop("own"), "name"))
        left = free.count()
        while left:
            leaders = free.groupBy("bucket").agg(F.max_by(F.struct(F.col("name").alias("leader"), F.col("k").alias("l")), F.struct("many", "name")).alias("of")).select("bucket", "of.*")
            pairs = written(free.join(leaders, "bucket").where("name <> leader"))
            close = pairs.where(alike("k", "l")).select(F.col("name").alias("a"), F.col("leader").alias("b")).distinct()
            own = written(verified(close, sets, least))
            links.append(own)
            rest = pairs.join(own, (F.col("name") == own.a) & (F.col("leader") == own.b), "left_anti")
            free, before = written(rest.drop("leader", "l")), left
            left = free.count()
            if before - left < 0.1 * before:
                break
        if not left:
            return reduce(DataFrame.unionByName, links) if links else verified(members.select(F.col("name").alias("a"), F.col("name").alias("b")).where(F.lit(False)), sets, least)
        again = written(dealt_again(free.select("name").distinct(), known, rows))
        sizes = again.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = again.join(sizes, "bucket")
        close = sized.where(F.col("n") <= MANY).select("bucket", "name", "k").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(near, "a long, b long")
        links.append(written(verified(close.distinct(), sets, least)))
        members = sized.where(F.col("n") > MANY).select("bucket", "name")
        rows += STEP


class Meeting:
    """Rows (bucket, name, component, shingles, place, bits) sorted by bucket, some whole buckets at a time."""

    def __init__(self, t: pa.Table):
        self.name, self.component, self.shingles, self.place = (t.column(c).to_numpy() for c in ("name", "component", "shingles", "place"))
        self.bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)  # of signed numbers NumPy counts the bits of the absolute value
        self.begin = _starts(t.column("bucket").to_numpy())
        self.size = np.diff(np.append(self.begin, t.num_rows))

    def may(self, x: np.ndarray | int, y: np.ndarray | slice, least: float) -> np.ndarray:
        """Whether rows of different components may be similar, by sizes, places and parities."""
        both = self.shingles[x] + self.shingles[y]
        left = np.minimum(self.shingles[x] - self.place[x], self.shingles[y] - self.place[y])
        good = (self.component[x] != self.component[y]) & (left >= least / (1 + least) * both - 1e-6)
        return good & (np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(1) <= (1 - least) / (1 + least) * both + 1e-6)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket in tables that cut no bucket."""
    wait: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        bucket = batch.column("bucket").to_numpy()
        first = int(np.argmax(bucket != bucket[0])) if bucket[0] != bucket[-1] else 0
        end = int(_starts(bucket)[-1])
        if wait and wait[-1].column("bucket")[0].as_py() != bucket[0]:
            yield pa.Table.from_batches(wait)
            wait = []
        if end:
            yield pa.Table.from_batches([*wait, batch.slice(0, first)])
            if end > first:
                yield pa.Table.from_batches([batch.slice(first, end - first)])
            wait = []
        wait.append(batch.slice(end))
    if wait:
        yield pa.Table.from_batches(wait)


PARTNERS = pa.schema([("bucket", pa.int64()), ("name", pa.int64()), ("component", pa.int64())])


def partners(least: float):
    """Of rows (bucket, name, component, shingles, place, bits) sorted by bucket those that may be similar to
    one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            m = Meeting(t)
            hit = np.zeros(t.num_rows, bool)
            small = np.repeat(m.size <= FEW, m.size)
            of = np.repeat(np.arange(len(m.size)), m.size)
            for lag in range(1, min(FEW, int(m.size.max()))):
                x = np.flatnonzero((of[lag:] == of[:-lag]) & small[lag:])
                x = x[m.may(x, x + lag, least)]
                hit[x] = hit[x + lag] = True
            for g, n in zip(m.begin[m.size > FEW].tolist(), m.size[m.size > FEW].tolist(), strict=True):
                for x in range(g, g + n - 1):
                    may = m.may(x, slice(x + 1, g + n), least)
                    hit[x] |= may.any()
                    hit[x + 1 : g + n] |= may
            yield from t.select(PARTNERS.names).filter(pa.array(hit)).cast(PARTNERS).to_batches()
        release()

    return run


def joined(least: float):
    """Of rows (bucket, name, component, own, shingles, place, bits) sorted by bucket the links (a, b) that join
    the components of similar rows of each bucket, fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            m, links = Meeting(t), []
            own = [np.frombuffer(x, np.uint64) for x in t.column("own").to_pylist()]
            m.component = m.component.copy()
            for g, n in zip(m.begin.tolist(), m.size.tolist(), strict=True):
                of = m.component[g : g + n]
                for x in range(g, g + n - 1):
                    for y in (x + 1 + np.flatnonzero(m.may(x, slice(x + 1, g + n), least))).tolist():
                        if m.component[x] != m.component[y] and similar(own[x], own[y], least):
                            links.append((m.name[x], m.name[y]))
                            of[of == m.component[y]] = m.component[x]
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=LINKS)
        release()

    return run


def by_rarity(sets: DataFrame, counted: DataFrame, least: float) -> DataFrame:
    """(token, name, component, shingles, place): the prefixes of sets (name, component, own) by a second order:
    first what isn't among the MOST frequent shingles of counted (token, many), then those, rarest first."""
    known = counted.orderBy(F.desc("many"), "token").limit(MOST).toArrow()
    token, many = (known.column(c).to_numpy() for c in ("token", "many"))
    order = np.argsort(token)
    sent = sets.sparkSession.sparkContext.broadcast((token[order], many[order]))

    def prefix(own: np.ndarray) -> list:
        token, many = sent.value
        at = np.minimum(np.searchsorted(token, own), len(token) - 1)
        rank = np.lexsort((own, np.where(token[at] == own, many[at], 0)))
        return own[rank[: int(prefix_length(np.array(len(own)), least))]].tolist()

    def run(names: list, components_: list, own: list) -> list:
        sets_ = [np.frombuffer(x, np.int64) for x in own]
        return [names, components_, [len(x) for x in sets_], list(map(prefix, sets_))]

    schema = pa.schema([("name", pa.int64()), ("component", pa.int64()), ("shingles", pa.int32()), ("tokens", pa.list_(pa.int64()))])
    each = map_columns(sets, ["name", "component", "own"], run, "name long, component long, shingles int, tokens array<long>", schema)
    return each.select("name", "component", "shingles", F.posexplode("tokens").alias("place", "token"))


def open_tokens(rows: DataFrame) -> DataFrame:
    """(token, many) of rows (token, component): the tokens in several components."""
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", "many")


def missed(tokens: DataFrame, links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b), written, between classes with a shingle in common in tokens (token, name, shingles, place),
    such as `links` leaves apart."""
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = components(links).withColumnRenamed("node", "name")
    rows = tokens.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
    rows = written(rows.join(open_tokens(rows), "token"))
    frequent = rows.where(F.col("many") > FEW)
    columns = ["bucket", "name", "component", "shingles", "place"]
    meet = rows.where(F.col("many") <= FEW).withColumn("bucket", F.col("token")).select(columns)
    again = None
    if not frequent.isEmpty():
        known = sets.join(frequent.select("name", "component").distinct(), "name")
        again = written(by_rarity(known, frequent.select("token", "many").distinct(), least))
        dealt = again.join(open_tokens(again), "token").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
        dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(name), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        meet = meet.unionByName(dealt.withColumn("bucket", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))).select(columns))
    found = meet.join(sets.select("name", "bits"), "name").repartition(n, "bucket").sortWithinPartitions("bucket")
    found = written(found.mapInArrow(partners(least), "bucket long, name long, component long"))
    whole = found.join(sets, "name").withColumn("shingles", F.expr("cast(length(own) / 8 as int)")).withColumn("place", F.lit(0))
    made = written(whole.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(joined(least), "a long, b long").distinct())
    dropped(rows, found, *([again] if again else []))
    return made


def repeats(docs: DataFrame, least_words: int = 20, least_similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(all paragraphs, repeated ones) of docs (doc_id, text_key, text).

    All: doc_id, text_key, line, first, size, n1, n2. Repeated: the same and stays (struct: doc_id,
    text_key, first; the paragraph that stays of its component) and removed (it isn't that one).
    """
    found = written(paragraphs(docs, least_words))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = banded(docs, least_words, least_similarity)
    rows = written(
        bands.repartition(n, F.when(F.col("kind") == STAYS, F.xxhash64("band", "name")).otherwise(F.col("band")))
        .sortWithinPartitions("band").mapInArrow(candidates, "bucket long, a long, b long, shingles int, place int")
    )
    tokens = rows.where("shingles is not null").select(F.col("bucket").alias("token"), F.col("a").alias("name"), "shingles", "place")
    pairs = rows.where("bucket is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    members = rows.where("bucket is not null and shingles is null").select("bucket", F.col("a").alias("name"))
    names = rows.select(F.col("a").alias("n1")).unionByName(rows.where("bucket is null").select(F.col("b").alias("n1"))).distinct()
    at = F.struct("doc_id", "text_key", "first")
    classes = found.repartition("n1", "n2").groupBy("n1", "n2").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("stays"), F.min(F.struct("doc_id", "text_key", "first", "size")).alias("place"),
    ).join(names.withColumn("collides", F.lit(True)), "n1", "left")
    known = written(classes.where("n > 1 or collides"))
    # Links are between halves of names; a half that two classes share is linked to none.
    alone = known.where("collides").groupBy("n1").agg(F.count(F.lit(1)).alias("of"), F.first("place").alias("place")).where("of = 1")
    sets = written(shingle_sets(docs, alone.select(F.col("n1").alias("name"), "place.*")))
    links = verified(pairs, sets, least_similarity)
    if not members.isEmpty():
        members = members.join(sets.select("name"), "name", "left_semi")
        links = links.unionByName(led(members, sets, least_similarity))
    links = written(links)
    if not tokens.isEmpty():
        links = links.unionByName(missed(tokens.join(sets.select("name"), "name", "left_semi"), links, sets, least_similarity))
    dropped(rows, sets)
    groups = components(links).withColumnRenamed("node", "n1")
    known = known.join(groups, "n1", "left").where("n > 1 or component is not null")
    whole = F.struct(F.coalesce("component", "n1").alias("n1"), F.when(F.col("component").isNull(), F.col("n2")).alias("n2"))
    known = known.select("n1", "n2", "stays", whole.alias("component"))
    first = known.groupBy("component").agg(F.min("stays").alias("stays")).withColumnRenamed("component", "__of")
    stays = known.drop("stays").join(first, F.col("component").eqNullSafe(F.col("__of"))).drop("component", "__of")
    repeated = found.join(stays, ["n1", "n2"]).withColumn("removed", ~F.struct("doc_id", "text_key", "first").eqNullSafe(F.col("stays")))
    return found, repeated


def passages(units: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """(first word, word after the last) of the runs of adjoining pieces (first, size) of `least_words`."""
    out: list[list[int]] = []
    for first, size in sorted(set(units)):
        if out and out[-1][1] == first:
            out[-1][1] = first + size
        else:
            out.append([first, first + size])
    return [(a, b) for a, b in out if b - a >= least_words]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def paragraph_duplicates(docs: DataFrame, least_words: int = 20, least_similarity: float = 0.8) -> DataFrame:
    """For each doc_id of docs (doc_id, text): n_paragraphs (lines of least_words or more), n_linked (those
    in a component of several), n_removed, kept_in (doc_ids that keep what is removed of lines, sorted),
    n_passages (passages of repeated pieces), passage_words and passage_words_removed.

    Rows that share a doc_id are one document; equal rows count once for what stays. Null and empty texts
    have no paragraphs; rows with a null doc_id are one document of that id; an empty table gives an empty
    one; further columns are ignored.
    """
    every, repeated = repeats(keyed(docs), least_words, least_similarity)
    whole = repeated.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("line", "first", "size", "removed", F.col("stays.doc_id").alias("kept"))).alias("units")
    )

    def run(ids: list, units: list) -> list:
        out = []
        for i, own in zip(ids, units, strict=True):
            lines = [x for x in own if x["line"]]
            pieces = [x for x in own if not x["line"]]
            linked = passages([(x["first"], x["size"]) for x in pieces], least_words)
            gone = passages([(x["first"], x["size"]) for x in pieces if x["removed"]], least_words)
            kept = sorted({x["kept"] for x in lines if x["removed"] and x["kept"] is not None})
            out.append((i, len(lines), sum(x["removed"] for x in lines), kept, len(linked), sum(b - a for a, b in linked), sum(b - a for a, b in gone)))
        return list(zip(*out, strict=True))

    columns = ["n_linked", "n_removed", "kept_in", "n_passages", "passage_words", "passage_words_removed"]
    made = map_columns(
        whole, ["doc_id", "units"], run, "doc_id long, n_linked long, n_removed long, kept_in array<long>, n_passages long, passage_words long, passage_words_removed long",
        pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int64()) if c == "kept_in" else pa.int64()) for c in columns)]),
    )
    none, nothing = F.lit(0).cast("long"), F.lit(None).cast("array<long>")
    counts = every.where("line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("p"))
    rows = made.withColumn("p", none)
    for other in (docs.select("doc_id", none.alias("p")), counts):
        rows = rows.unionByName(other.select("doc_id", "p", *(nothing.alias(c) if c == "kept_in" else none.alias(c) for c in columns)))
    sums = [F.sum(c).alias(c) for c in columns if c != "kept_in"]
    return rows.groupBy("doc_id").agg(F.sum("p").alias("n_paragraphs"), *sums, F.flatten(F.collect_list("kept_in")).alias("kept_in")).select(
        "doc_id", "n_paragraphs", "n_linked", "n_removed", F.array_sort(F.array_distinct("kept_in")).alias("kept_in"), *columns[3:]
    )


def without(text: bytes, lines: set[int], spans: list[tuple[int, int]]) -> bytes:
    """The text without the lines that begin with the given words (by place in the text) and without the
    words of the spans, each with what follows it up to the next word of its line. A line whose words are
    all gone goes as a whole."""
    raw = np.frombuffer(text, np.uint8)
    mark = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    gone = np.zeros(len(begin), bool)
    for a, b in spans:
        gone[a:b] = True
    breaks = np.append(np.flatnonzero(raw == 10), len(raw))
    line_of = np.searchsorted(breaks, begin)
    start = np.concatenate(([0], breaks[:-1] + 1))
    for at in lines:
        gone[line_of == line_of[at]] = True
    cut = np.zeros(len(raw) + 1, np.int32)
    after = np.append(begin[1:], len(raw)) if len(begin) else end
    last = np.minimum(after, breaks[line_of])
    np.add.at(cut, begin[gone], 1)
    np.add.at(cut, last[gone], -1)
    left = np.cumsum(cut[:-1]) == 0
    n, k = len(breaks), np.bincount(line_of, minlength=len(breaks))
    stays = (k == 0) | (np.bincount(line_of, weights=gone, minlength=n) < k)
    return b"\n".join(raw[a:b][left[a:b]].tobytes() for a, b, x in zip(start.tolist(), breaks.tolist(), stays.tolist(), strict=True) if x)


def without_repeats(docs: DataFrame, least_words: int = 20, least_similarity: float = 0.8) -> DataFrame:
    """docs with their columns, without the removed lines and passages; n_chars follows the text where it exists.

    Documents of which nothing but white space stays are dropped if something was removed. Null and empty
    texts stay; rows without a doc_id are told apart by their texts; rows that are equal in both keep or lose
    the same; an empty table gives an empty one.
    """
    own = docs.withColumn("__key", F.xxhash64("text"))
    _, repeated = repeats(keyed(docs), least_words, least_similarity)
    gone = repeated.where("removed").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__at")).agg(F.collect_set(F.struct("line", "first", "size")).alias("__gone"))
    joined = own.join(gone, own.doc_id.eqNullSafe(F.col("__id")) & (own["__key"] == F.col("__at")), "left").drop("__id", "__at", "__key")
    names, counted = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in parts(b)):
            texts, found = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__gone").to_pylist()
            keep, chars = [], []
            for i, g in enumerate(found):
                left = None
                if g:
                    spans = passages([(x["first"], x["size"]) for x in g if not x["line"]], least_words)
                    lines = {x["first"] for x in g if x["line"]}
                    if spans or lines:
                        left = texts[i] = without(texts[i], lines, spans)
                keep.append(left is None or bool(left.strip()))
                chars.append(None if left is None else len(left.decode()))
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, pa.binary()).cast(batch.column("text").type)
            if counted:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([o if c is None else c for c, o in zip(chars, old, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names).filter(pa.array(keep, pa.bool_()))
        release()

    return joined.mapInArrow(run, docs.schema)
