"""MPEG transport streams (ISO/IEC 13818-1) as a media column.

``mux`` stores samples as one program with one elementary stream: program
tables, PES packets with presentation timestamps, a clock reference and the
random-access indicator at every ``RANDOM_ACCESS``-th access unit. ``demux``
reads stored bytes back: it follows the program tables to the stream, checks
the continuity counters and table checksums, reassembles elementary packets
and returns timestamps and random-access points.

A packet that repeats its predecessor (same counter, same content but for the
clock reference) is a duplicate that the standard allows once, and is left
out; a jump of the counter at a packet with the discontinuity indicator is
announced and no error.

Both are row-wise over binary columns in Arrow batches and never shuffle.

Defined cases: null samples are empty and give program tables alone; bytes
that aren't whole packets, lose sync or miss a table raise nothing but are
counted in ``errors``; a null media column demuxes to an empty payload; equal
samples give equal streams, however often they occur; samples of any length
are one stream; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, NULL_PID = 0x1000, 0x0100, 0x1FFF
#: Samples of 8 bits in an access unit, and samples a second.
UNIT, RATE = 1920, 8000
CLOCK = 90_000
RANDOM_ACCESS = 16
PES_HEADER = 14


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The checksum of program tables: most significant bit first."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return (b"\0" + head + struct.pack(">I", crc32_mpeg(head))).ljust(PACKET - 4, b"\xff")


_PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(2, 1, struct.pack(">HH", 0xE000 | STREAM_PID, 0xF000) + struct.pack(">BHH", 0x06, 0xE000 | STREAM_PID, 0xF000))


def _pts(t: int) -> bytes:
    return bytes((0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1))


def mux(payload: bytes | None, unit: int = UNIT) -> bytes:
    """A transport stream that holds ``payload`` losslessly."""
    payload = payload or b""
    out, tables, cc = [], 0, 0
    flags = struct.pack(">H", STREAM_PID)
    start = struct.pack(">H", 0x4000 | STREAM_PID)
    for k in range(max(1, -(-len(payload) // unit))):
        at = k * CLOCK * unit // RATE & (1 << 33) - 1
        access = k % RANDOM_ACCESS == 0
        if access:
            out += [b"\x47\x40\x00", bytes((0x10 | tables & 15,)), _PAT, b"\x47", struct.pack(">H", 0x4000 | PMT_PID), bytes((0x10 | tables & 15,)), _PMT]
            tables += 1
        data = payload[k * unit : k * unit + unit]
        if not data:
            break
        pes = b"\0\0\1\xbd" + struct.pack(">H", len(data) + 8) + b"\x84\x80\x05" + _pts(at) + data
        extra = b"\x50" + struct.pack(">IH", at >> 1, (at & 1) << 15 | 0x7E00) if access else b""
        where, first = 0, True
        while where < len(pes):
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            left = min(room, len(pes) - where)
            fill = room - left
            if extra or fill:
                body = extra or (b"\0" if fill > 1 else b"")
                stuffing = fill if extra else max(0, fill - 2)
                field = bytes((len(body) + stuffing,)) + body + b"\xff" * stuffing
                control = 0x30
            else:
                field, control = b"", 0x10
            out += [b"\x47", start if first else flags, bytes((control | cc,)), field, pes[where : where + left]]
            cc = cc + 1 & 15
            where, first, extra = where + left, False, b""
    return b"".join(out)


def _table(packets: np.ndarray, begin: np.ndarray, rows: np.ndarray, table_id: int) -> tuple[bytes | None, int]:
    """Body of the last good section on a packet id, and how many are bad."""
    body, bad = None, 0
    for r in rows:
        data = packets[r, begin[r] :].tobytes()
        section = data[1 + data[0] :] if data else b""
        size = (section[1] & 15) << 8 | section[2] if len(section) > 3 else 0
        if size < 9 or len(section) < size + 3 or section[0] != table_id or crc32_mpeg(section[: size + 3]):
            bad += 1
        else:
            body = section[8 : size - 1]
    return body, bad


def _continuous(packets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Of one packet id's packets with payload (row numbers ``at``): those
    that are no allowed duplicates, and the number of counter errors."""
    counter = packets[at, 3] & 15
    again = np.zeros(len(at), bool)
    for k in (np.flatnonzero(counter[1:] == counter[:-1]) + 1).tolist():
        a, b = packets[at[k - 1]].copy(), packets[at[k]].copy()
        if a[3] & 0x20 and a[4] >= 7 and a[5] & 0x10:  # the clock reference may differ
            a[6:12] = b[6:12]
        again[k] = not again[k - 1] and bool((a == b).all())
    kept = at[~again]
    own = packets[kept]
    announced = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)
    jumps = (own[1:, 3] & 15) != (own[:-1, 3] + 1 & 15)
    return kept, int((jumps & ~announced[1:]).sum())


def demux(media: bytes | None) -> dict:
    """What a stream holds; see the fields of :data:`DEMUXED`."""
    media = media or b""
    found = {"payload": b"", "packets": len(media) // PACKET, "units": 0, "random_access": 0, "errors": int(len(media) % PACKET > 0), "pts": [], "access": [], "stream_type": -1}
    packets = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] < 0x80)
    found["errors"] += int((~good).sum())
    packets = packets[good]
    pid = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + packets[:, 4].astype(np.int64), 4)
    found["errors"] += int((begin > PACKET).sum())
    begin = np.minimum(begin, PACKET)
    starts = (packets[:, 1] & 0x40 > 0) & (control & 1 > 0)
    pat, bad = _table(packets, begin, np.flatnonzero((pid == 0) & starts), 0)
    found["errors"] += bad
    programs = [struct.unpack_from(">HH", pat, i) for i in range(0, len(pat or b"") - 3, 4)]
    program = next((p & 0x1FFF for n, p in programs if n), None)
    if program is None:
        found["errors"] += 1
        return found
    pmt, bad = _table(packets, begin, np.flatnonzero((pid == program) & starts), 2)
    found["errors"] += bad
    if pmt is None or len(pmt) < 9:
        found["errors"] += 1
        return found
    kind, stream = struct.unpack_from(">BH", pmt, 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0xFFF))
    found["stream_type"] = kind
    for p in (0, program, stream & 0x1FFF):
        own, bad = _continuous(packets, np.flatnonzero((pid == p) & (control & 1 > 0)))
        found["errors"] += bad
    es, begin, starts = packets[own], begin[own], starts[own]  # the stream's come last
    if not len(es):
        return found
    first = np.flatnonzero(starts)
    found["errors"] += int(first[0]) if len(first) else len(es)  # packets before any start
    access = np.zeros(len(es), bool)
    with_field = (es[:, 3] & 0x20 > 0) & (es[:, 4] > 0)
    access[with_field] = es[with_field, 5] & 0x40 > 0
    data = es[np.arange(PACKET) >= begin[:, None]]
    ends = np.cumsum(PACKET - begin)
    at = (ends - (PACKET - begin))[first]
    until = np.append(at[1:], len(data)) if len(at) else at
    parts, pts, marks = [], [], []
    for a, b, mark in zip(at.tolist(), until.tolist(), access[first].tolist(), strict=True):
        unit = data[a:b].tobytes()
        size = int.from_bytes(unit[4:6]) if len(unit) > 8 else 0
        if unit[:3] != b"\0\0\1" or size and size + 6 != len(unit):
            found["errors"] += 1
            continue
        head = 9 + unit[8]
        if unit[7] & 0x80 and head >= PES_HEADER:
            t = unit[9:14]
            pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        else:
            pts.append(-1)
        marks.append(mark)
        parts.append(unit[head:])
    return found | {"payload": b"".join(parts), "units": len(parts), "random_access": sum(marks), "pts": pts, "access": marks}


DEMUXED = "payload binary, packets long, units long, random_access long, errors long, pts array<long>, access array<boolean>, stream_type int"


def muxed(samples: Column) -> Column:
    """A binary column as a column of transport streams."""

    @F.pandas_udf("binary")
    def store(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: mux(None if x is None else bytes(x)))

    return store(samples)


def demuxed(media: Column) -> Column:
    """A column of transport streams as structs of :data:`DEMUXED`."""

    @F.pandas_udf(DEMUXED)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([demux(None if x is None else bytes(x)) for x in part], columns=[c.split()[0] for c in DEMUXED.split(", ")])

    return read(media)


def features(payload: bytes, found: dict) -> str:
    """Counts of the stream and simple statistics of its samples, as text.

    Mean and spread are integers in thousandths, crossings count passes
    through 128, so that equal payloads have equal features everywhere.
    """
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    mean = int(x.sum()) * 1000 // max(1, len(x))
    spread = int((x * x).sum()) * 1000 // max(1, len(x)) - mean * mean // 1000
    crossings = int(np.count_nonzero(np.diff(x > 127)))
    span = (found["pts"][-1] - found["pts"][0]) if found["pts"] else 0
    return f"packets={found['packets']};units={found['units']};access={found['random_access']};errors={found['errors']};span={span};mean={mean};var={spread};crossings={crossings}"
