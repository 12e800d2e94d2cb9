"""Operator 7: SimHash near-duplicates by anchor points.

A covering code is the product of nine perfect Hamming [7,4] codes over bits 0-62; bit 63 is left out.
Every fingerprint has a home anchor, the code word within radius 1 of it in each block. Two fingerprints
that differ in at most two bits have a midpoint that differs from either in at most one, so the midpoint's
home is an anchor of both: it suffices to replicate a fingerprint to the homes of its ball of radius 1
(within covering radius plus half the threshold; 25 anchors on average, where the whole threshold needs
over 300), and to compare within each anchor.

Only distinct fingerprints are replicated. Within an anchor, small groups are compared directly; larger
ones by their own midpoints, all fingerprints within one bit of the same word being linked in a chain, so
no group ever emits its pairs. Links then go to connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, written
from .components import components

SEED, SHINGLE, CHUNK = 42, 3, 1 << 16
ONE = np.uint64(1)
#: Bits of each byte value, highest first.
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1


def hashes(w: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of `size` words of a word list, in chunks; fewer words are one shingle."""
    if 0 < len(w) < size:
        w = [b" ".join(w)]
        yield np.array([xxhash.xxh64_intdigest(w[0], SEED)], np.uint64)
        return
    for at in range(0, len(w) - size + 1, CHUNK):
        part = w[at : at + CHUNK + size - 1]
        made = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(size)), strict=False)]
        yield np.array(made, np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingles' hashes. No words: zero."""
    count, n = np.zeros(64, np.int64), 0
    for h in hashes(text.lower().split(), size):
        n += len(h)
        columns = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            count[8 * k : 8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ BYTE_BITS
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of each row of docs (doc_id, text); fp is the fingerprint as a signed long,
    text_key a hash of the text."""

    def run(ids: list, keys: list, texts: list) -> list:
        made = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
        return [ids, keys, made.tolist()]

    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_columns(own, ["doc_id", "text_key", "text"], run, "doc_id long, text_key long, fp long", pa.schema([(c, pa.int64()) for c in ("doc_id", "text_key", "fp")]))


def homes(fp: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint: every 7-bit block becomes the code word within one bit of it."""
    out = np.zeros_like(fp)
    for block in range(9):
        x = (fp >> np.uint64(7 * block)) & np.uint64(127)
        out |= DECODE[x.astype(np.int64)] << np.uint64(7 * block)
    return out


def _decode_table() -> np.ndarray:
    """Nearest word of the Hamming [7,4] code, whose checks are the bits of the places 1 to 7."""
    out = np.zeros(128, np.uint64)
    for x in range(128):
        syndrome = 0
        for place in range(1, 8):
            if x >> (place - 1) & 1:
                syndrome ^= place
        out[x] = x ^ (1 << (syndrome - 1) if syndrome else 0)
    return out


DECODE = _decode_table()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for each anchor within radius 1 of a fingerprint's ball of radius 1."""
    home = homes(fp)
    found, index = [home], [np.arange(len(fp))]
    for block in range(9):
        shift = np.uint64(7 * block)
        rest = home & ~(np.uint64(127) << shift)
        x = ((fp >> shift) & np.uint64(127)).astype(np.int64)
        made = np.stack([DECODE[x ^ (1 << k)] for k in range(7)] + [DECODE[x]], 1)
        made.sort(axis=1)
        fresh = np.ones(made.shape, bool)
        fresh[:, 1:] = made[:, 1:] != made[:, :-1]
        fresh &= made != DECODE[x][:, None]
        row, col = np.nonzero(fresh)
        found.append(rest[row] | made[row, col] << shift)
        index.append(row)
    return np.concatenate(found), np.concatenate(index)


def linked(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at two bits or fewer among distinct fingerprints."""
    keys = np.concatenate([fp, *(fp ^ (ONE << np.uint64(k)) for k in range(64))])
    owner = np.tile(np.arange(len(fp)), 65)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    same = keys[1:] == keys[:-1]
    return fp[owner[:-1][same]], fp[owner[1:][same]]


def compare(anchor: np.ndarray, fp: np.ndarray, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal anchors (rows are sorted by anchor)."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    big = sizes > small
    a, b = [], []
    for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
        for out, x in zip((a, b), linked(fp[s : s + n]), strict=True):
            out.append(x)
    for lag in range(1, min(small, int(sizes.max(initial=1)))):
        near = (anchor[lag:] == anchor[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= 2)
        if big.any():
            near &= np.repeat(~big, sizes)[lag:]
        a.append(fp[:-lag][near])
        b.append(fp[lag:][near])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
REPLICAS = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), CHUNK):
            part = fp[at : at + CHUNK]
            anchor, index = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[index].view(np.int64))], schema=REPLICAS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; the last anchor of a batch waits for the next batch."""
    anchor = fp = np.zeros(0, np.uint64)

    def out() -> pa.RecordBatch:
        a, b = (x.view(np.int64) for x in compare(anchor[:end], fp[:end]))
        a, b = np.minimum(a, b), np.maximum(a, b)
        links = np.unique(np.stack([a, b], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=LINKS)

    for batch in batches:
        if batch.num_rows:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(2))
            anchor, fp = np.concatenate((anchor, x)), np.concatenate((fp, y))
            end = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
            if end:
                yield out()
                anchor, fp = anchor[end:], fp[end:]
    end = len(anchor)
    if end:
        yield out()


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep what two bits or fewer connect."""
    replicas = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    n = replicas.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = replicas.repartition(int(n), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def components_of(fps: DataFrame) -> DataFrame:
    """(fp, component): of the distinct fingerprints that are linked to others."""
    return components(links(fps.select("fp").distinct())).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, the smallest
    doc_id that is reachable over fingerprints differing in two bits or fewer. size: words of a shingle.

    Null and wordless texts have the fingerprint zero and are linked like any other. Rows with a null
    doc_id have a fingerprint but don't name a component (null where no other row is in it). Repeated rows
    repeat. An empty table gives an empty one; further columns are ignored.
    """
    fps = written(fingerprints(docs, size))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components_of(fps)
    named = (
        classes.join(found, "fp")
        .groupBy("component").agg(F.min("least").alias("component_id"))
    )
    labels = classes.join(found, "fp", "left").join(named, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id (rows without one
    come last), of several such the one of the smallest text hash. size: words of a shingle.

    Rows that share both doc_id and text are one document, of which one row stays. Null and wordless texts
    are copies of each other. An empty table gives an empty one.
    """
    fps = written(fingerprints(docs, size))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = fps.groupBy("fp").agg(F.min(row).alias("least")).join(components_of(fps), "fp", "left")
    first = classes.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("least").alias("least"))
    stay = first.select(F.col("least.doc_id").alias("__id"), F.col("least.text_key").alias("__at"))
    own = docs.withColumn("__key", F.xxhash64("text"))
    kept = own.join(stay, own.doc_id.eqNullSafe(F.col("__id")) & (own["__key"] == F.col("__at")), "left_semi")
    if not fps.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__key"])
    return kept.select(*docs.columns)
