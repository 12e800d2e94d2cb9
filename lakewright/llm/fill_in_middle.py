"""Operator 12: fill-in-the-middle examples from texts kept as seekable compressed frames.

A text is cut into units (`[A-Za-z]+|[^A-Za-z]`, over code points) and stored as zstandard frames of about
`frame_bytes`, each independent, beginning at a unit, and known by the units and code points before it. Two
cuts, drawn from a hash of the id, are found by the counts: only the frames that hold them are decompressed
to place them. Everything else streams: the parts of an example are read frame by frame in the order of its
form, so digests never hold a text whole; and its text is rebuilt from the example's own stream, whose
sections are kept as frames again until their turn comes.

A text is one row of the store, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The order of an example's parts: 0 prefix, 1 middle, 2 suffix.
ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
FRAME_BYTES = 16_384

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True


def unit_starts(text: bytes, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit starts, and whether a code point starts, at each byte of a UTF-8 text; after_letter:
    a letter stands before it."""
    raw = np.frombuffer(text, np.uint8)
    letter, point = _letter[raw], (raw & 0xC0) != 0x80
    follows = np.empty(len(raw), bool)
    follows[1:] = letter[:-1]
    follows[:1] = after_letter
    return point & ~(letter & follows), point


Frame = tuple[int, int, bytes]  # units before it, code points before it, data


def frames(text: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[list[Frame], int, int]:
    """The frames of a text, its units and its code points. A frame ends at the first unit that starts
    `frame_bytes` or more behind its begin; an empty text has no frame."""
    made, units, chars, at = [], 0, 0, 0
    while at < len(text):
        end, step = min(len(text), at + frame_bytes), max(64, frame_bytes // 4)
        while end < len(text):  # look for the next unit, some bytes at a time
            start, _ = unit_starts(text[end : end + step], bool(_letter[text[end - 1]]))
            if start.any():
                end += int(start.argmax())
                break
            end = min(len(text), end + step)
        start, point = unit_starts(text[at:end])
        made.append((units, chars, zstandard.ZstdCompressor().compress(text[at:end])))
        units, chars, at = units + int(start.sum()), chars + int(point.sum()), end
    return made, units, chars


FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
STORE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("marked", pa.bool_()), ("frames", FRAMES)])
STORE_SQL = "doc_id long, n long, chars long, marked boolean, frames array<struct<units:long,chars:long,data:binary>>"


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The texts of docs (doc_id, text) as frames: doc_id, n (units), chars, marked (the text holds a marker),
    frames (units and code points before each, data).

    A null text counts as empty and has no frames; ids may be null or repeat; an empty table gives an empty
    one; further columns are ignored.
    """

    def run(ids: list, texts: list) -> list:
        out = []
        for i, t in zip(ids, texts, strict=True):
            t = t or b""
            own, n, chars = frames(t, frame_bytes)
            out.append((i, n, chars, any(m in t for m in (PREFIX, SUFFIX, MIDDLE)), [{"units": u, "chars": c, "data": d} for u, c, d in own]))
        return list(zip(*out, strict=True)) if out else [[]] * 5

    return map_columns(docs, ["doc_id", "text"], run, STORE_SQL, STORE)


class Stored:
    """One text of the store."""

    def __init__(self, n: int, chars: int, own: list[dict]):
        self.n, self.chars, self.own = n, chars, own
        self.units = [f["units"] for f in own]

    def raw(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.own[k]["data"])

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte within it, code points before) of a unit; the end of the text is its last frame's end."""
        if unit >= self.n:
            return len(self.own), 0, self.chars
        k = bisect_right(self.units, unit) - 1
        if self.units[k] == unit:
            return k, 0, self.own[k]["chars"]
        start, point = unit_starts(self.raw(k))
        at = int(np.flatnonzero(start)[unit - self.units[k]])
        return k, at, self.own[k]["chars"] + int(point[:at].sum())

    def between(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> Iterator[bytes]:
        """The bytes from one place to another, frame by frame."""
        for k in range(a[0], b[0] + (b[1] > 0)):
            yield self.raw(k)[a[1] if k == a[0] else 0 : b[1] if k == b[0] else None]


def numbers(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four numbers of 32 bits for an id; no id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def form_of(n: int, marked: bool, h: list[int], rate: int, spm: int) -> str:
    """plain, psm or spm: `rate` of 100 texts become an example, `spm` of 100 of those with the suffix first."""
    return "plain" if not n or marked or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"


def example(text: Stored, form: str, h: list[int]) -> tuple[int | None, int | None, Iterator[bytes]]:
    """(code points of the prefix, of the middle, the example's bytes in order)."""
    ends = [(0, 0, 0), text.place(text.n)]
    if form == "plain":
        return None, None, text.between(*ends)
    low, high = (text.place(u) for u in sorted((h[0] % (text.n + 1), h[1] % (text.n + 1))))
    bounds = [ends[0], low, high, ends[1]]

    def parts() -> Iterator[bytes]:
        for marker, k in ORDER[form]:
            yield marker
            yield from text.between(bounds[k], bounds[k + 1])

    return low[2], high[2] - low[2], parts()


def sections(stream: Iterable[bytes], markers: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number of the marker before it, bytes) of a stream that begins with the first of the markers, each of
    which stands in it once, in this order. A marker may lie across two pieces of the stream."""
    wait, k = b"", -1
    for piece in stream:
        wait += piece
        while k + 1 < len(markers) and (at := wait.find(markers[k + 1])) >= 0:
            if at:
                yield k, wait[:at]
            wait, k = wait[at + len(markers[k + 1]) :], k + 1
        safe = len(wait) - (max(map(len, markers)) - 1 if k + 1 < len(markers) else 0)
        if safe > 0:
            yield k, wait[:safe]
            wait = wait[safe:]
    if wait:
        yield k, wait


def restored(stream: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The text of an example, from its form and its bytes alone; sections wait as frames."""
    if form == "plain":
        yield from stream
        return
    order = ORDER[form]
    kept: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
    for k, piece in sections(stream, [m for m, _ in order]):
        kept[order[k][1]].append(zstandard.ZstdCompressor().compress(piece))
    for part in (0, 1, 2):
        for data in kept[part]:
            yield zstandard.ZstdDecompressor().decompress(data)


def _each(ids: list, n: list, chars: list, marked: list, own: list, rate: int, spm: int, seed: str) -> Iterator[tuple]:
    for i, count, points, m, f in zip(ids, n, chars, marked, own, strict=True):
        h = numbers(i, seed)
        yield i, count, Stored(count, points, f), form_of(count, m, h, rate, spm), h


COLUMNS = ["doc_id", "n", "chars", "marked", "frames"]


def examples(kept: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and output, the example itself, for each row
    of a store. An empty text gives an empty plain example."""

    def run(*columns: list) -> list:
        out = []
        for i, n, text, form, h in _each(*columns, rate, spm, seed):
            p, m, stream = example(text, form, h)
            out.append((i, n, form, p, m, b"".join(stream).decode()))
        return list(zip(*out, strict=True)) if out else [[]] * 6

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    return map_columns(kept, COLUMNS, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", schema)


def _hashed(stream: Iterable[bytes], into) -> Iterator[bytes]:
    for piece in stream:
        into.update(piece)
        yield piece


def digests(kept: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and n_frames for each row of
    a store: of the examples as `examples` makes them, streamed."""

    def run(*columns: list) -> list:
        out = []
        for i, n, text, form, h in _each(*columns, rate, spm, seed):
            p, m, stream = example(text, form, h)
            made, back = hashlib.sha256(), hashlib.sha256()
            for piece in restored(_hashed(stream, made), form):
                back.update(piece)
            out.append((i, n, form, p, m, made.hexdigest(), back.hexdigest(), len(text.own)))
        return list(zip(*out, strict=True)) if out else [[]] * 8

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
        ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("n_frames", pa.int64()),
    ])
    return map_columns(kept, COLUMNS, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, n_frames long", schema)
