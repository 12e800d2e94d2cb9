"""Operator 4: media columns as MPEG transport streams.

A payload becomes access units of 576 bytes. Each unit is one PES packet (private stream 1, with a
presentation time) in four transport packets of 188 bytes; every 25th unit is a random-access point and
comes after a programme association and a programme map table. The reader takes any stream of one programme:
it parses the tables (each one's checksum is checked, the last version counts), leaves out packets that are
sent twice, checks continuity counters, reads the clock, reassembles the packets of the first elementary
stream, and stores their times with the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns

# Fixed values of the format, and this stream's own numbers.
PACKET, SYNC, STREAM, PMT_PID, ES_PID, PRIVATE = 188, 0x47, 0xBD, 0x1000, 0x100, 0x06
UNIT, TICKS, RAP_EVERY, CLOCK0 = 576, 3600, 25, 90_000
#: Unit bytes in the four packets of a PES packet: 12 bytes of adaptation (with the clock) and 14 of header first.
SHARE = (184 - 12 - 14, 184, 184, 50)


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        x = b << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        table.append(x)
    return table


CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x = (x << 8 ^ CRC[x >> 24 ^ b]) & 0xFFFFFFFF
    return x


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + data
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


PAT = table_packet(0, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = table_packet(
    PMT_PID,
    section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0"),
)


def _unit_packets() -> np.ndarray:
    """The four packets of a unit without its bytes, times and counters."""
    p = np.full((4, PACKET), 255, np.uint8)
    p[:, 0], p[:, 1], p[:, 2], p[:, 3] = SYNC, ES_PID >> 8, ES_PID & 255, 0x10
    p[0, 1] |= 0x40
    p[0, 3], p[0, 4], p[0, 5] = 0x30, 11, 0x10
    length = UNIT + 8
    p[0, 16:24] = [0, 0, 1, STREAM, length >> 8, length & 255, 0x80, 0x80]
    p[0, 24] = 5
    p[3, 3], p[3, 4], p[3, 5] = 0x30, 183 - SHARE[3], 0
    return p


UNIT_PACKETS = _unit_packets()


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * ((-len(text)) % UNIT if text else UNIT)


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload whose length is a positive multiple of UNIT."""
    n = len(payload) // UNIT
    data = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    p = np.broadcast_to(UNIT_PACKETS, (n, 4, PACKET)).copy()
    at = 0
    for k, share in enumerate(SHARE):
        p[:, k, PACKET - share :] = data[:, at : at + share]
        at += share
    p[:, :, 3] |= (np.arange(4 * n) & 15).astype(np.uint8).reshape(n, 4)
    pts = CLOCK0 + TICKS * np.arange(n, dtype=np.int64)
    for c, v in enumerate((0x21 | pts >> 29 & 14, pts >> 22, 1 | pts >> 14 & 254, pts >> 7, 1 | pts << 1 & 254)):
        p[:, 0, 25 + c] = v & 255
    for c, v in enumerate((pts >> 25, pts >> 17, pts >> 9, pts >> 1, (pts & 1) << 7 | 0x7E, 0 * pts)):
        p[:, 0, 6 + c] = v & 255
    raps = -(-n // RAP_EVERY)
    p[::RAP_EVERY, 0, 5] |= 0x40
    out = np.empty((4 * n + 2 * raps, PACKET), np.uint8)
    unit, step = np.arange(4 * n) // 4, 2 * np.arange(raps) + 4 * RAP_EVERY * np.arange(raps)
    out[np.arange(4 * n) + 2 * (unit // RAP_EVERY + 1)] = p.reshape(-1, PACKET)
    for k, t in enumerate((PAT, PMT)):
        out[step + k] = t
        out[step + k, 3] |= (np.arange(raps) & 15).astype(np.uint8)
    return out.tobytes()


@dataclass
class Stream:
    """What the reader finds: payload, times of the elementary packets, which of them are random-access
    points, continuity errors, the programme's streams (PID, type), packets, those sent twice, and the clock
    (ticks of 27 MHz)."""

    payload: bytes
    pts: np.ndarray
    random_access: np.ndarray
    errors: int
    streams: list[tuple[int, int]]
    packets: int
    twice: int
    clock: np.ndarray


def read_section(packet: np.ndarray) -> bytes:
    """Body of the section in a packet; raises if its checksum is wrong."""
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    raw = raw[at + 1 + raw[at] :]
    end = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    if crc_mpeg(raw[:end]):
        raise ValueError("a table's checksum is wrong")
    return raw[8 : end - 4]


def last_table(packets: np.ndarray) -> bytes:
    """Body of the last of some repeated tables; each version's checksum is checked."""
    versions = dict.fromkeys(x.tobytes() for x in packets[:, 4:]) if len(packets) < 64 else {x.tobytes(): None for x in np.unique(packets[:, 4:], axis=0)}
    for x in versions:
        read_section(np.frombuffer(packets[0, :4].tobytes() + x, np.uint8))
    return read_section(packets[-1])


def demux(stream: bytes) -> Stream:
    """Read a single-programme stream: tables, continuity, elementary packets, times."""
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if not (p[:, 0] == SYNC).all():
        raise ValueError("a packet has no sync byte")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    pat = last_table(p[pid == 0])
    pmt_pid = int.from_bytes(pat[2:4], "big") & 0x1FFF
    pmt = last_table(p[pid == pmt_pid])
    at, streams = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF), []
    while at < len(pmt):
        streams.append((int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, pmt[at]))
        at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    errors = twice = 0
    for x in (0, pmt_pid, streams[0][0]):
        own = p[pid == x]
        own = own[own[:, 3] & 0x10 != 0]  # packets without a payload don't count on
        again = np.zeros(len(own), bool)
        again[1:] = (own[1:] == own[:-1]).all(axis=1)
        again[2:] &= ~again[1:-1]  # twice, not more
        own = own[~again]
        twice += int(again.sum())
        errors += int(np.count_nonzero(np.diff(own[:, 3] & 15) & 15 != 1))
    timed = p[(p[:, 3] & 0x20 != 0) & (p[:, 4] > 0) & (p[:, 5] & 0x10 != 0), 6:12].astype(np.int64)
    base = timed[:, 0] << 25 | timed[:, 1] << 17 | timed[:, 2] << 9 | timed[:, 3] << 1 | timed[:, 4] >> 7
    clock = base * 300 + ((timed[:, 4] & 1) << 8 | timed[:, 5])
    adapted = own[:, 3] & 0x20 != 0
    offset = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    begins = own[:, 1] & 0x40 != 0
    data = own[np.arange(PACKET) >= offset[:, None]]
    starts = (np.cumsum(PACKET - offset) - (PACKET - offset))[begins]
    if not (data[starts[:, None] + np.arange(3)] == (0, 0, 1)).all():
        raise ValueError("an elementary packet has no start code")
    t = data[starts[:, None] + np.arange(9, 14)].astype(np.int64)
    pts = (t[:, 0] & 14) << 29 | t[:, 1] << 22 | (t[:, 2] & 254) << 14 | t[:, 3] << 7 | t[:, 4] >> 1
    head = 9 + data[starts + 8].astype(np.int64)
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + head, -1)
    payload = data[np.cumsum(mark[:-1]) == 0].tobytes()
    return Stream(payload, pts, flags[begins] & 0x40 != 0, errors, streams, len(p), twice, clock)


def media(docs: DataFrame, keep_stream: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): the text's stream, read back, and its features.

    Columns: those of the query op4, among them the times of the elementary packets (pts, ticks of 90 kHz),
    the numbers of the random-access ones and the clock's first and last value (ticks of 27 MHz); with
    keep_stream also the stream itself. A null text counts as empty: one unit of padding. Equal
    texts give equal values; rows are independent, so repeated ids and rows repeat; an empty table gives
    an empty one; further columns are ignored. Texts of any length are one stream.
    """

    def run(doc_ids: list, texts: list) -> list:
        out = []
        for i, t in zip(doc_ids, texts, strict=True):
            text = t or b""
            stored = mux(padded(text))
            s = demux(stored)
            own = s.payload
            duration = int(s.pts[-1] - s.pts[0]) + TICKS
            feature = (
                f"units={len(s.pts)};packets={s.packets};streams={','.join(f'{a}:{b}' for a, b in s.streams)}"
                f";pts={s.pts[0]}-{s.pts[-1]};random_access={int(s.random_access.sum())};errors={s.errors}"
                f";clock={s.clock[0]}-{s.clock[-1]};twice={s.twice};bits_per_second={len(stored) * 8 * 90_000 // duration}"
            )
            row = (
                i, len(text), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]),
                len(stored), hashlib.sha256(stored).hexdigest(), feature,
            )
            row = (*row, s.pts.tolist(), np.flatnonzero(s.random_access).tolist())
            out.append((*row, stored) if keep_stream else row)
        return list(zip(*out, strict=True))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64()))]
    if keep_stream:
        schema += ", stream binary"
        fields.append(("stream", pa.binary()))
    return map_columns(docs, ["doc_id", "text"], run, schema, pa.schema(fields))
