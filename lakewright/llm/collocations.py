"""Operator 13: phrases whose words stand together more often than chance, from a weighted de Bruijn graph.

Nodes of the graph are phrases of longest - 1 words, edges those of `longest` words, weighted by their
occurrences within pieces. Each chunk of texts makes its own graph and compacts it: edges of one weight whose
common node has no other edge become one path. A path's edges are summed over all chunks, and a shorter
phrase's count is the flow out of its nodes (the weights of all edges that begin with it) plus a correction
for places where a piece ends before the edge is full.

Only phrases with `least` occurrences matter, and all parts of such a phrase occur as often. So the graph
leaves out words, and then pairs of words, that are rarer: words and pairs are counted first, and two bitmaps
of hashes tell which are frequent (they may let rarer ones pass, which costs time and changes nothing, as each
phrase is counted fully or not at all). They are Bloom filters of three places a hash, have 128 bits for each
frequent word or pair and 16 MiB at most, whatever the corpus; that is all that is collected or broadcast. As these passes count words and pairs, the
graph's flow gives the phrases from three words on.

Words of a pair are named by 64-bit hashes until pairs are counted (two of 10^8 frequent words share one with
probability 0.0003); all other counts are by the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, release, written

#: Separators of pieces become line feeds.
PIECES = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))
#: Bytes of text that are words at a time; a longer piece comes alone.
CHUNK = 6 << 20
#: Bits of a bitmap for each hash, and the least and most bits.
BITS, LEAST_BITS, MOST_BITS = 128, 1 << 20, 1 << 27
PLACES = 3  # of a hash in a bitmap
SPARK_BITS = 1 << 15  # of one row of Spark's bitmap functions
#: Factors of the first and second word's hash (any odd 64-bit numbers do).
FACTORS = np.random.default_rng(13).integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of some pieces of one language: `of` the distinct ones, `ids` the place in it of each word,
    `more` whether the next word stands in the same piece."""

    def __init__(self, lang: str, text: list[bytes]):
        pieces = [w for t in text for p in t.split(b"\n") if (w := p.split())]
        self.lang = lang
        flat = list(chain.from_iterable(pieces))
        self.of = list(set(flat))
        place = dict(zip(self.of, range(len(self.of)), strict=True))
        self.ids = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        self.more = np.ones(len(flat), bool)
        if flat:
            self.more[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) - 1] = False

    def hashes(self) -> np.ndarray:
        head = self.lang.encode() + b"\0"
        return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in self.of), np.uint64, len(self.of))

    def pairs(self, h: np.ndarray, words: Bitmap) -> np.ndarray:
        """Where a pair begins of which no word is rare; h: the words' hashes."""
        known = words.has(h)[self.ids]
        return np.flatnonzero(self.more & known & np.append(known[1:], False))

    def text(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.of.__getitem__, ids))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs from those of their words."""
    x = a * FACTORS[0] + b * FACTORS[1]
    x = (x ^ (x >> np.uint64(32))) * FACTORS[0]
    return x ^ (x >> np.uint64(29))


class Bitmap:
    """A set of hashes by some of their bits."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = np.uint64(8 * len(bits) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at, step, out = (h >> np.uint64(1)) & self.mask, (h >> np.uint64(33)) | np.uint64(1), np.ones(len(h), bool)
        for _ in range(PLACES):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at = (at + step) & self.mask
        return out


def bitmap(hashes: DataFrame) -> bytes:
    """The bits of a Bitmap of the column h; its size follows their number, up to MOST_BITS."""
    size = LEAST_BITS
    count = hashes.count()
    while size < min(MOST_BITS, BITS * count):
        size *= 2
    first, step = F.shiftrightunsigned("h", 1).bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 33).bitwiseOR(F.lit(1))
    places = hashes.select(F.explode(F.array(*((first + step * k).bitwiseAND(F.lit(size - 1)) for k in range(PLACES)))).alias("place"))
    at = F.col("place") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(size // 8)
    for k, bits in rows.toLocalIterator():
        out[(k - 1) * SPARK_BITS // 8 : k * SPARK_BITS // 8] = bits
    return bytes(out)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of rows (lang, text), some CHUNK bytes of a language at a time; a chunk ends between pieces."""
    wait: dict[str, list[bytes]] = defaultdict(list)
    total: dict[str, int] = defaultdict(int)
    for batch in (part for b in batches for part in parts(b)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text, at = (text or b"").lower().translate(PIECES), 0
            while at < len(text):
                end = len(text)
                if end - at > CHUNK:
                    cut = text.find(b"\n", at + CHUNK)
                    end = cut + 1 if cut >= 0 else end
                wait[lang].append(text[at:end])
                total[lang] += end - at
                at = end
                if sum(total.values()) >= CHUNK:
                    big = max(total, key=total.__getitem__)
                    yield Words(big, wait.pop(big))
                    del total[big]
    for lang, own in wait.items():
        yield Words(lang, own)
    release()


WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
PATHS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's count, and a row without a word that counts all."""
    for w in chunks(batches):
        n = np.bincount(w.ids, minlength=len(w.of))
        words = pa.array([*w.of, None], pa.binary()).cast(pa.string())
        h = pa.array(np.append(w.hashes().view(np.int64), 0))
        yield pa.RecordBatch.from_arrays([pa.array([w.lang] * (len(w.of) + 1), pa.string()), words, h, pa.array(np.append(n, n.sum()))], schema=WORDS)


def paths(w: Words, links: np.ndarray, longest: int) -> tuple[list[bytes], list[int]]:
    """The compacted graph of some words, of which `links` tells whether each is followed: paths of `longest`
    words or more, each standing for all its edges with one weight, and, shorter than that, the phrases of three
    words or more before an end, with their numbers."""
    reach = np.ones(len(w.ids), np.int64)
    further = links
    for k in range(1, longest):
        reach += further
        further = further & np.append(links[k:], np.zeros(min(k, len(links)), bool))[: len(links)]
    phrases, numbers = [], []
    gram = w.ids
    u = len(w.of)
    for k in range(2, longest + 1):
        at = np.flatnonzero(reach >= k)
        if not len(at):
            break
        _, first, of = np.unique(gram[at] * u + w.ids[at + k - 1], return_index=True, return_inverse=True)
        first, nodes = at[first], gram
        gram = np.zeros(len(w.ids), np.int64)
        gram[at] = of
        n = np.bincount(of[reach[at] == k] if k < longest else of, minlength=len(first))
        if k < longest:
            for i in np.flatnonzero(n).tolist() if k > 2 else ():  # pairs are counted before
                phrases.append(w.text(w.ids[first[i] : first[i] + k].tolist()))
                numbers.append(int(n[i]))
            continue
        # Edges of one weight with a node of their own between them belong to one path.
        tail, head = nodes[first], nodes[first + 1]
        size = int(max(tail.max(), head.max())) + 1
        only = (np.bincount(tail, minlength=size) == 1) & (np.bincount(head, minlength=size) == 1)
        out = np.zeros(size, np.int64)
        out[tail] = np.arange(len(first))
        after = np.where(only[head] & (n[out[head]] == n), out[head], -1)
        begins = np.ones(len(first), bool)
        begins[after[after >= 0]] = False
        last, seen = w.ids[first + k - 1].tolist(), np.zeros(len(first), bool)
        after = after.tolist()
        for i in chain(np.flatnonzero(begins).tolist(), range(len(first))):  # rings have no begin
            if not seen[i]:
                ids = w.ids[first[i] : first[i] + k].tolist()
                seen[i] = True
                j = after[i]
                while j >= 0 and not seen[j]:
                    seen[j] = True
                    ids.append(last[j])
                    j = after[j]
                phrases.append(w.text(ids))
                numbers.append(int(n[i]))
    return phrases, numbers


def _pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(joined(a, b).view(np.int64))], ["h"])


def graph(rows: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (lang, text), all written: words (lang, word, n; those of `least` or more, and each lang's sum
    where word is null), pairs (lang, phrase, n; of `least` or more) and edges (lang, phrase, n; of `longest`
    words, or from three words on before an end)."""
    spark = rows.sparkSession
    words = written(rows.mapInArrow(_word_counts, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()))
    known = spark.sparkContext.broadcast(bitmap(words.where("word is not null")))

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in chunks(batches):
            h = w.hashes()
            at = w.pairs(h, Bitmap(known.value))
            of, n = np.unique(w.ids[at] * len(w.of) + w.ids[at + 1], return_counts=True)
            a, b = (h[x].view(np.int64) for x in np.divmod(of, max(1, len(w.of))))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], schema=PAIRS)

    counted = written(rows.mapInArrow(pair_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    linked = spark.sparkContext.broadcast(bitmap(counted.mapInArrow(_pair_hashes, "h long")))
    named = words.where("word is not null")
    pairs = counted.join(named.select(F.col("h").alias("a"), "lang", F.col("word").alias("first")), "a").join(named.select(F.col("h").alias("b"), F.col("word").alias("second")), "b")
    pairs = written(pairs.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "n"))

    def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in chunks(batches):
            h = w.hashes()
            at = w.pairs(h, Bitmap(known.value))
            links = np.zeros(len(w.ids), bool)
            links[at] = Bitmap(linked.value).has(joined(h[w.ids[at]], h[w.ids[at + 1]]))
            phrases, n = paths(w, links, longest)
            yield pa.RecordBatch.from_arrays([pa.array([w.lang] * len(n), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=PATHS)

    own = rows.mapInArrow(compacted, "lang string, phrase string, n long").withColumn("w", F.split("phrase", " "))
    window = lambda i: F.array_join(F.slice(F.col("w"), i, longest), " ")
    each = F.when(F.size("w") <= longest, F.array("phrase")).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - longest + 1), window))
    edges = own.select("lang", "n", F.explode(each).alias("phrase")).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return words, pairs, written(edges)


def flow(edges: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n): the occurrences of all phrases of three words or more with which edges begin. Those of
    k words are the sums of those of k + 1 that begin with them and of edges that end there."""
    w = F.split("phrase", " ")
    sized = edges.withColumn("size", F.size(w))
    out = level = sized.where(F.col("size") == longest).drop("size")
    for k in range(longest - 1, 2, -1):
        begins = level.select("lang", F.array_join(F.slice(w, 1, k), " ").alias("phrase"), "n")
        level = begins.unionByName(sized.where(F.col("size") == k).drop("size")).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        out = out.unionByName(level)
    return out


#: floor(1000 * a * n / (l * r)), exactly: products have up to 38 digits, and div leaves no fraction to round.
SCORE = "({a} * {n} * 1000BD) div ({l} * {r})".format(**{c: f"cast({c} as decimal(19,0))" for c in "anlr"})


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int | None = 2000) -> DataFrame:
    """Of docs (lang, text), for each lang: the phrases of two to `longest` (three or more) words that occur `least` times or
    more, by score; `most` of them, or all (None). Columns: lang, rank (from 1), phrase, a (its occurrences),
    l and r (those of the parts of its lowest-scoring cut), n (all words of the lang), score.

    The score is floor(1000 * a * n / (l * r)), exactly; a phrase inside a longer one that occurs as often is
    left out. Ranks are by score and a, both descending, then by the bytes of the phrase. A null lang counts
    as `und`, null and empty texts have no words, equal rows count each; an empty table gives an empty one;
    further columns are ignored.
    """
    words, pairs, edges = graph(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), least, longest)
    own = written(pairs.unionByName(flow(edges, longest).where(F.col("n") >= least)))
    known = own.unionByName(words.where("word is not null").select("lang", F.col("word").alias("phrase"), "n"))
    w = F.split("phrase", " ")
    part = lambda a, b: F.array_join(F.slice(w, a, b), " ")
    cuts = own.withColumnRenamed("n", "a").select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.withColumn("first", part(1, F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.size(w)))
    for c, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(c), F.col("n").alias(n)), ["lang", c])
    cuts = cuts.join(words.where("word is null").select("lang", "n"), "lang")
    cuts = cuts.withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The largest count of a longer phrase around each one.
    size = F.size(w)
    places = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: part(i, k))))
    inside = own.where(size > 2).select("lang", "n", F.explode(places).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    left = best.join(inside, ["lang", "phrase"], "left").where("around is null or around < a")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    out = left.withColumn("rank", rank.cast("long")).select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return out if most is None else out.where(F.col("rank") <= most)
