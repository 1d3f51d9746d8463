"""Capture files as a data source: pcap and pcapng, one file over many tasks.

``read_capture`` gives the frame table of :data:`framewright.sources.frames.SCHEMA`
from radiotap, bare 802.11 or Ethernet captures, ``write_capture`` writes one
file a task. A file is cut into splits by bytes alone. A split begins at the
first offset from which ``CHAIN`` records follow one another plausibly (or the
file ends with one), and ends before the first record that begins beyond it;
the same search carries a reader over a damaged stretch, so all ways to cut a
file give the same frames and the same number of damaged stretches.

What a split can't know, how many frames come before it and which sections and
interfaces of a pcapng hold where it starts, comes from a first pass over
record headers (:func:`capture_index`): a row a split, with the few section
blocks it has met. Time windows, subtypes and addresses are pushed down: a
frame outside is skipped before its body is decoded.

Defined cases: a file without a known magic number raises; a record that is cut
off, implausible or of an unknown interface is damage; a frame that ends early
or is encrypted has null in the fields it lacks; frames with a bad checksum
(where radiotap says so) are kept, as the decoder keeps them; an empty capture
has no frames. Files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import contextlib
import json
import struct
import uuid
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from framewright.sources.frames import COLUMNS, SCHEMA

# First bytes of a capture (order of bytes, parts of a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION = b"\x0a\x0d\x0d\x0a"
# Link types and pcapng blocks.
ETHERNET, BARE, RADIOTAP = 1, 105, 127
INTERFACE, SIMPLE, ENHANCED = 1, 3, 6
#: Records that must follow one another where a split begins; the longest one,
#: and how far (in seconds) its time may be from the file's first.
CHAIN, LONGEST, SPAN_S = 4, 1 << 24, 366 * 86_400
#: Bytes before a split from which its reader walks.
LOOK_BACK = 1 << 18
SPLIT_BYTES = 64 << 20
#: Bytes fetched at once and rows sent at once.
_FETCH, _ROWS = 1 << 20, 4096
INDEX_SCHEMA = "path string, start long, frames long, damaged long, marks array<struct<at: long, block: binary>>"


def has_capture_magic(head: bytes) -> bool:
    """Whether a file's first bytes are those of a capture."""
    return head[:4] in MAGIC or head[:4] == SECTION


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class _Bytes:
    """Bytes of a file at any place, fetched in large pieces."""

    def __init__(self, path: str) -> None:
        fs, at = _located(path)
        self.file = fs.open_input_file(at)
        self.size, self.start, self.piece = self.file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.start <= at or at + n > self.start + len(self.piece):
            self.file.seek(at)
            self.start, self.piece = at, self.file.read(max(n, _FETCH))
        return self.piece[at - self.start : at - self.start + n]


@dataclass
class _Layout:
    """How records lie in a file: what holds at a place of it."""

    data: _Bytes
    order: str = "<"
    parts: int = 10**6
    link: int | None = None
    ng: bool = False
    first_s: int | None = None
    interfaces: list[tuple[int, int, int]] = field(default_factory=list)  # link, parts of a second, seconds to add

    @classmethod
    def of(cls, data: _Bytes) -> _Layout:
        head = data.get(0, 24)
        if head[:4] == SECTION:
            return cls(data, ng=True)
        if head[:4] not in MAGIC or len(head) < 24:
            raise ValueError("not a capture: unknown magic number")
        order, parts = MAGIC[head[:4]]
        own = cls(data, order, parts, struct.unpack(order + "I", head[20:24])[0] & 0xFFFF)
        first = data.get(24, 4)
        own.first_s = struct.unpack(order + "I", first)[0] if len(first) == 4 and own.after(24) else None
        return own

    @property
    def begin(self) -> int:
        return 0 if self.ng else 24

    def after(self, at: int) -> int | None:
        """Where the record or block at ``at`` ends; null if none can be there."""
        if not self.ng:
            head = self.data.get(at, 16)
            if len(head) < 16:
                return None
            second, part, kept, length = struct.unpack(self.order + "4I", head)
            fits = part < self.parts and 0 < kept <= length < LONGEST and (self.first_s is None or abs(second - self.first_s) <= SPAN_S)
            end = at + 16 + kept
            return end if fits and end <= self.data.size else None
        head = self.data.get(at, 12)
        if len(head) < 12:
            return None
        order = self.order
        if head[:4] == SECTION:
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else ""
        size = struct.unpack(order + "I", head[4:8])[0] if order else 0
        if size < 12 or size % 4 or size > LONGEST or at + size > self.data.size:
            return None
        return at + size if self.data.get(at + size - 4, 4) == head[4:8] else None

    def follows(self, at: int) -> bool:
        """Whether a chain of records begins at ``at``."""
        for _ in range(CHAIN):
            if at == self.data.size:
                return True
            at = self.after(at)
            if at is None:
                return False
        return True

    def sync(self, at: int, last: int) -> int | None:
        """The first place in [at, last) where a chain begins. Blocks lie at
        multiples of four; both orders of bytes are tried where none is known."""
        step = 4 if self.ng else 1
        at += -at % step
        while at < last:
            for order in (self.order, ">" if self.order == "<" else "<") if self.ng else (self.order,):
                kept, self.order = self.order, order
                if self.follows(at):
                    return at
                self.order = kept
            at += step
        return None

    def met(self, block: bytes) -> None:
        """Take over a section's or interface's block."""
        if block[:4] == SECTION:
            self.order, self.interfaces = "<" if block[8:12] == b"\x4d\x3c\x2b\x1a" else ">", []
            return
        link, at, parts, add = struct.unpack(self.order + "H", block[8:10])[0], 16, 10**6, 0
        while at + 4 <= len(block) - 4:
            code, n = struct.unpack(self.order + "2H", block[at : at + 4])
            value = block[at + 4 : at + 4 + n]
            if not code:
                break
            if code == 9 and n == 1:
                parts = 1 << (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
            elif code == 14 and n == 8:
                add = struct.unpack(self.order + "q", value)[0]
            at += 4 + n + (-n % 4)
        self.interfaces.append((link, parts, add))

    def record(self, at: int, end: int) -> tuple[int, int, int, bytes] | None:
        """(link, microseconds, length, bytes) of a record; null if it is a
        block of another kind, ``ValueError`` if it can't be read."""
        if not self.ng:
            second, part, _, length = struct.unpack(self.order + "4I", self.data.get(at, 16))
            return self.link, second * 10**6 + part * 10**6 // self.parts, length, self.data.get(at + 16, end - at - 16)
        kind = struct.unpack(self.order + "I", self.data.get(at, 4))[0]
        if kind == ENHANCED and end - at >= 32:
            face, high, low, kept, length = struct.unpack(self.order + "5I", self.data.get(at + 8, 20))
            if face >= len(self.interfaces) or kept > end - at - 32:
                raise ValueError
            link, parts, add = self.interfaces[face]
            return link, (high << 32 | low) * 10**6 // parts + add * 10**6, length, self.data.get(at + 28, kept)
        if kind == SIMPLE and self.interfaces:  # it has no time
            raise ValueError
        return None


def _walked(layout: _Layout, start: int, end: int) -> Iterator[tuple[int, int | None]]:
    """Places and ends of records that begin in [start, end); a damaged
    stretch has no end. The walk begins earlier, so that it comes upon a
    damaged stretch near ``start`` as a walk over the whole file does."""
    early = max(layout.begin, start - LOOK_BACK)
    at = early if early == layout.begin else layout.sync(early, end)
    while at is not None and at < end and at < layout.data.size:
        after = layout.after(at)
        if after is not None and layout.ng and layout.data.get(at, 4) == SECTION:
            layout.order = "<" if layout.data.get(at + 8, 4) == b"\x4d\x3c\x2b\x1a" else ">"
        if at >= start:
            yield at, after
        at = after if after is not None else layout.sync(at + 1, end)


def _is_frame(layout: _Layout, at: int) -> bool:
    return not layout.ng or struct.unpack(layout.order + "I", layout.data.get(at, 4))[0] in (SIMPLE, ENHANCED)


def _mark(layout: _Layout, at: int, after: int) -> bytes | None:
    """A section's or interface's block, else null."""
    if not layout.ng:
        return None
    head = layout.data.get(at, 4)
    found = head == SECTION or struct.unpack(layout.order + "I", head)[0] == INTERFACE
    return layout.data.get(at, after - at) if found else None


# Alignment and size of radiotap's fields by bit.
TAP = {0: (8, 8), 1: (1, 1), 2: (1, 1), 3: (2, 4), 4: (2, 2), 5: (1, 1), 6: (1, 1), 7: (2, 2), 8: (2, 2), 9: (2, 2), 10: (1, 1), 11: (1, 1), 12: (1, 1), 13: (1, 1), 14: (2, 2), 15: (2, 2), 16: (1, 1), 17: (1, 1), 18: (4, 8), 19: (1, 3), 20: (4, 8), 21: (2, 12), 22: (8, 12), 23: (2, 12), 24: (2, 12), 25: (2, 6), 26: (1, 1), 27: (2, 4)}


def tapped(data: bytes) -> tuple[dict, bytes]:
    """Fields of a radiotap header, and the frame after it (without checksum)."""
    size = struct.unpack("<H", data[2:4])[0]
    out, checked = _tap_fields(data[:size], size)
    frame = data[size:]
    return out, frame[:-4] if checked else frame


@lru_cache(1 << 12)
def _tap_fields(data: bytes, size: int) -> tuple[dict, bool]:
    """Fields of a header (not to be changed: few headers are distinct), and
    whether a checksum ends the frame."""
    present, at = [], 4
    while at + 4 <= size:
        present.append(struct.unpack("<I", data[at : at + 4])[0])
        at += 4
        if not present[-1] >> 31:
            break
    seen, out = {}, {"mcs_phy": "Legacy"}
    for word in present[:1]:  # what antennas add comes later; the first is kept
        for bit in range(29):
            if word >> bit & 1:
                if bit not in TAP:
                    break
                align, n = TAP[bit]
                at += -at % align
                seen[bit] = data[at : at + n] if at + n <= size else b""
                at += n
    if seen.get(2):
        out["data_rate"] = f"{seen[2][0] / 2:g}"
    if seen.get(3):
        out["channel_freq"] = struct.unpack("<H", seen[3][:2])[0]
    if seen.get(5):
        out["rssi"] = seen[5][0] - 256 * (seen[5][0] > 127)
    if seen.get(19) and seen[19][0] & 2:
        out |= {"mcs_phy": "HT", "mcs": seen[19][2]}
        out["nss"] = seen[19][2] // 8 + 1 if seen[19][2] < 32 else 1 if seen[19][2] == 32 else None
    if seen.get(21):
        out |= {"mcs_phy": "VHT", "mcs": seen[21][4] >> 4, "nss": seen[21][4] & 15 or None}
    if seen.get(23):
        he = struct.unpack("<6H", seen[23])
        out |= {"mcs_phy": "HE", "mcs": he[2] >> 8 & 15, "nss": he[5] & 15 or None}
    return out, bool(seen.get(1) and seen[1][0] & 0x10)


@lru_cache(1 << 12)
def _mac(data: bytes) -> str | None:
    return data.hex(":") if len(data) == 6 else None


@lru_cache(1 << 12)
def _address(data: bytes) -> str | None:
    return ".".join(map(str, data)) if len(data) == 4 else None


def _eapol(body: bytes) -> int | None:
    """Message of a four-way handshake by its key information's flags."""
    if len(body) < 7 or body[1] != 3:
        return None
    info = struct.unpack(">H", body[5:7])[0]
    if not info & 0x0008:
        return None
    if info & 0x0080:
        return 3 if info & 0x0100 else 1
    return None if not info & 0x0100 else 4 if info & 0x0200 else 2


def _payload(kind: int, body: bytes) -> dict:
    """Fields above the link: addresses, echoes, ARP, TCP, key messages."""
    if kind == 0x0806:
        return {"protocol": "ARP", "arp_opcode": struct.unpack(">H", body[6:8])[0] if len(body) >= 8 else None}
    if kind == 0x888E:
        return {"protocol": "EAPOL", "eapol_msgnr": _eapol(body)}
    if kind == 0x86DD:
        return {"protocol": {58: "ICMPv6", 6: "TCP", 17: "UDP"}.get(body[6] if len(body) > 6 else -1, "IPv6")}
    if kind != 0x0800 or len(body) < 20:
        return {}
    head, total = (body[0] & 15) * 4, struct.unpack(">H", body[2:4])[0]
    out = {"protocol": {1: "ICMP", 6: "TCP", 17: "UDP"}.get(body[9], "IPv4"), "ip_src": _address(body[12:16]), "ip_dst": _address(body[16:20])}
    inner = body[head:]
    if struct.unpack(">H", body[6:8])[0] & 0x1FFF:  # a later fragment
        return out
    if body[9] == 1 and len(inner) >= 8:
        out["icmp_type"] = inner[0]
        if inner[0] in (0, 8):
            out["icmp_ident"], out["icmp_seq"] = (str(struct.unpack(">H", inner[4:6])[0]), struct.unpack(">H", inner[6:8])[0])
    elif body[9] == 6 and len(inner) >= 14:
        out |= {"tcp_len": total - head - (inner[12] >> 4) * 4, "tcp_flags": f"0x{struct.unpack('>H', inner[12:14])[0] & 0xFFF:04x}"}
    return out


def decoded(link: int, data: bytes, keep: set[int] | None = None) -> dict | None:
    """Fields of one frame; null if its subtype isn't among those to keep."""
    out: dict = {"protocol": "802.11", "retry": False, "mcs_phy": "Legacy"}
    if link == ETHERNET:
        kind = struct.unpack(">H", data[12:14])[0] if len(data) >= 14 else 0
        return None if keep is not None else out | {"protocol": "Ethernet", "ta": _mac(data[6:12]), "ra": _mac(data[:6])} | _payload(kind, data[14:])
    if link == RADIOTAP and len(data) >= 8:
        tap, data = tapped(data)
        out |= tap
    if link not in (RADIOTAP, BARE) or len(data) < 2:
        return out if keep is None else None
    kind, flags = data[0] >> 2 & 3, data[1]
    subtype = kind * 16 + (data[0] >> 4)
    if keep is not None and subtype not in keep:
        return None
    out |= {"subtype": subtype, "retry": bool(flags & 8), "ra": _mac(data[4:10])}
    if kind == 1:
        return out | ({"ta": _mac(data[10:16])} if subtype in (24, 25, 26, 27, 30) else {})
    if kind == 3 or len(data) < 24:
        return out
    to_ds, from_ds = flags & 1, flags >> 1 & 1
    bssid = data[4:10] if to_ds and not from_ds else data[10:16] if from_ds and not to_ds else data[16:22]
    out |= {"ta": _mac(data[10:16]), "seq": struct.unpack("<H", data[22:24])[0] >> 4}
    if not (to_ds and from_ds):
        out["bssid"] = _mac(bssid)
    at = 24 + 6 * (to_ds and from_ds)
    if kind == 0:
        body = data[at + 4 * bool(flags & 0x80) :]
        if flags & 0x40:
            return out
        if subtype in (5, 8) and len(body) >= 8:
            out["tsf"] = struct.unpack("<Q", body[:8])[0] if body[7] < 128 else None
        elif subtype in (10, 12) and len(body) >= 2:
            out["reason_code"] = struct.unpack("<H", body[:2])[0]
        elif subtype == 2:
            out["current_ap"] = _mac(body[4:10])
        return out
    mixed = False
    if subtype & 8:
        mixed = bool(data[at] & 0x80) if len(data) > at else False
        at += 2 + 4 * bool(flags & 0x80)
    body = data[at:]
    if subtype & 4 or flags & 0x40 or mixed or body[:3] != b"\xaa\xaa\x03":
        return out
    return out | _payload(struct.unpack(">H", body[6:8])[0] if len(body) >= 8 else 0, body[8:])


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    before: int = 0
    marks: list = field(default_factory=list)


class CaptureReader(DataSourceReader):
    """Splits of all files, and what each of them holds."""

    def __init__(self, options: dict, indexing: bool) -> None:
        self.path, self.source, self.indexing = options["path"], options.get("source", "w1"), indexing
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.low, self.high, self.subtypes, self.macs = None, None, None, []
        self.known = {}
        index = options.get("index")
        if index:
            self.known = {(path, start): (before, [base64.b64decode(m) for m in marks]) for path, start, before, marks in json.loads(index)}

    def __getstate__(self) -> dict:
        """What goes to each task: not the index, of which its split has its part."""
        return self.__dict__ | {"known": {}}

    def pushFilters(self, filters):  # noqa: N802
        """Time windows and subtypes are settled here, others are Spark's."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if self.indexing or at not in (("epoch_us",), ("subtype",)):
                yield f
            elif at == ("epoch_us",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low if self.low is not None else f.value, f.value + isinstance(f, GreaterThan))
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
            elif at == ("epoch_us",) and isinstance(f, LessThan | LessThanOrEqual):
                top = f.value + isinstance(f, LessThanOrEqual)
                self.high = top if self.high is None else min(self.high, top)
            elif at == ("subtype",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.subtypes = own if self.subtypes is None else self.subtypes & own
            else:
                yield f

    def partitions(self) -> list[Split]:
        out = []
        for path, size in _files(self.path):
            for start in range(0, max(size, 1), self.split_bytes):
                before, marks = self.known.get((path, start), (0, []))
                out.append(Split(path, start, min(size, start + self.split_bytes), before, marks))
        return out

    def read(self, split: Split) -> Iterator:
        return self._index(split) if self.indexing else self._frames(split)

    def _index(self, split: Split) -> Iterator[tuple]:
        layout, frames, damaged, marks = _Layout.of(_Bytes(split.path)), 0, 0, []
        for at, after in _walked(layout, split.start, split.end):
            if after is None:
                damaged += 1
                continue
            block = _mark(layout, at, after)
            if block is not None:
                marks.append((at, block))
                layout.met(block)
            frames += _is_frame(layout, at)
        yield split.path, split.start, frames, damaged, marks

    def _frames(self, split: Split) -> Iterator[pa.RecordBatch]:
        layout, number, rows = _Layout.of(_Bytes(split.path)), split.before, []
        for block in split.marks:
            layout.met(block)
        for at, after in _walked(layout, split.start, split.end):
            if after is None:
                continue
            block = _mark(layout, at, after)
            if block is not None:
                layout.met(block)
            if not _is_frame(layout, at):
                continue
            number += 1
            with contextlib.suppress(ValueError):  # of an unknown interface, or without a time
                link, t, length, data = layout.record(at, after)
                if (self.low is not None and t < self.low) or (self.high is not None and t >= self.high):
                    continue
                try:
                    found = decoded(link, data, self.subtypes)
                except (struct.error, IndexError):
                    found = {"protocol": "802.11", "retry": False} if self.subtypes is None else None
                if found is not None:
                    found.update(number=number, epoch_us=t, source=self.source, length=length)
                    rows.append(found)
            if len(rows) >= _ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


# Arrow's types of the frame table's columns.
_ARROW = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for c, kind in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _files(path: str) -> list[tuple[str, int]]:
    """Files of a folder (not hidden) or the one that is named, and their sizes."""
    fs, at = _located(path)
    info = fs.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    inner = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((prefix + x.path, x.size) for x in inner if x.type == pafs.FileType.File and x.base_name[:1] not in "._")


# Key information's flags of a handshake's four messages.
KEY_FLAGS = {1: 0x008A, 2: 0x010A, 3: 0x13CA, 4: 0x030A}


@lru_cache(1 << 12)
def _raw(mac: str | None) -> bytes:
    return bytes.fromhex(mac.replace(":", "")) if mac else bytes(6)


@lru_cache(1 << 12)
def _tap(data_rate: str | None, channel_freq: int | None, rssi: int | None, mcs: int | None, phy: str | None, nss: int | None) -> bytes:
    """A radiotap header of the fields that are known."""
    have, tap = 0, b""

    def put(bit: int, data: bytes) -> None:
        nonlocal have, tap
        have |= 1 << bit
        tap += bytes(-(8 + len(tap)) % TAP[bit][0]) + data

    if data_rate is not None:
        put(2, bytes([int(float(data_rate) * 2) & 0xFF]))
    if channel_freq is not None:
        put(3, struct.pack("<2H", channel_freq, 0))
    if rssi is not None:
        put(5, struct.pack("<b", rssi))
    if mcs is not None and phy not in ("VHT", "HE"):
        put(19, bytes([2, 0, mcs]))
    elif mcs is not None and phy == "VHT":
        put(21, bytes([0, 0, 0, 0, mcs << 4 | (nss or 0), 0, 0, 0, 0, 0, 0, 0]))
    elif mcs is not None:
        put(23, struct.pack("<6H", 0x20, 0, mcs << 8, 0, 0, nss or 0))
    return struct.pack("<2BHI", 0, 0, 8 + len(tap), have) + tap


@lru_cache(1 << 12)
def _ip(address: str) -> bytes:
    return bytes(map(int, address.split(".")))


def encoded(row) -> bytes:
    """A frame with its radiotap header, of the fields that its row has."""
    head = _tap(row.data_rate, row.channel_freq, row.rssi, row.mcs, row.mcs_phy, row.nss)
    if row.subtype is None:
        return head
    kind, ta, ra, bssid = row.subtype >> 4, _raw(row.ta), _raw(row.ra), _raw(row.bssid)
    flags = 8 * bool(row.retry)
    start = (row.subtype & 15) << 4 | kind << 2
    if kind == 1:
        return head + bytes([start, flags, 0, 0]) + ra + ta
    flags |= (1 if row.bssid == row.ra else 2 if row.bssid == row.ta else 0) if kind == 2 else 0
    third = bssid if not flags & 3 else bytes(6)
    body = bytes([start, flags, 0, 0]) + ra + ta + third + struct.pack("<H", (row.seq or 0) << 4)
    if kind == 0:
        body += {8: struct.pack("<QHH", row.tsf or 0, 100, 0), 5: struct.pack("<QHH", row.tsf or 0, 100, 0), 10: struct.pack("<H", row.reason_code or 0), 12: struct.pack("<H", row.reason_code or 0), 2: bytes(4) + _raw(row.current_ap)}.get(row.subtype, b"")
        return head + body
    body += bytes(2) if row.subtype & 8 else b""
    snap, inner = b"\xaa\xaa\x03\x00\x00\x00", b""
    if row.eapol_msgnr is not None or row.protocol == "EAPOL":
        return head + body + snap + b"\x88\x8e" + b"\x02\x03\x00\x5f\x02" + struct.pack(">H", KEY_FLAGS.get(row.eapol_msgnr, 0)) + bytes(92)
    if row.arp_opcode is not None:
        return head + body + snap + b"\x08\x06" + struct.pack(">2H2BH", 1, 0x800, 6, 4, row.arp_opcode) + bytes(20)
    if row.ip_src is None or row.ip_dst is None:
        return head + body
    if row.icmp_type is not None:
        number, inner = 1, struct.pack(">2B3H", row.icmp_type, 0, 0, int(row.icmp_ident or 0), row.icmp_seq or 0)
    elif row.tcp_len is not None:
        number, inner = 6, struct.pack(">2H2I2H2H", 0, 0, 0, 0, 0x5000 | int(row.tcp_flags or "0", 16), 0, 0, 0)
    else:
        number = 17
    total = 20 + len(inner) + (row.tcp_len or 0)
    ip = struct.pack(">2B3H2BH", 0x45, 0, total & 0xFFFF, 0, 0, 64, number, 0) + _ip(row.ip_src) + _ip(row.ip_dst)
    return head + body + snap + b"\x08\x00" + ip + inner


#: A row of the frame table, as a writer takes it from Arrow's columns.
_Frame = namedtuple("_Frame", COLUMNS)


def _listed(column: pa.Array) -> list:
    """A column's values, of which few are distinct, as a list."""
    if not column.null_count and pa.types.is_integer(column.type):
        return column.to_numpy().tolist()
    coded = column.dictionary_encode()
    values = [*coded.dictionary.to_pylist(), None]
    return [values[k] for k in coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).tolist()]


class CaptureWriter(DataSourceArrowWriter):
    """One capture a task; a frame's length is at least that of its bytes.

    A task writes under a hidden name, and the driver renames the files of the
    attempts that count once all are whole, so a lost one leaves no capture.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _located(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.pcap"
        with fs.open_output_stream(f"{at}/.{name}") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, RADIOTAP))
            for batch in batches:
                for row in map(_Frame, *(_listed(batch.column(c)) for c in COLUMNS)):
                    data = encoded(row)
                    out.write(struct.pack("<4I", row.epoch_us // 10**6, row.epoch_us % 10**6, len(data), max(len(data), row.length or 0)) + data)
        return _Written(f"{at}/.{name}", f"{at}/{name}")

    def commit(self, messages: list) -> None:
        fs, _ = _located(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.kept, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = _located(self.path)
        for m in messages:
            if m is not None:
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_file(m.kept)


@dataclass
class _Written(WriterCommitMessage):
    kept: str
    final: str


class CaptureSource(DataSource):
    """``spark.read.format("capture")``: path, source, splitBytes, mode=index."""

    planned = False

    @classmethod
    def name(cls) -> str:
        return "capture"

    def __getstate__(self) -> dict:
        """Once splits are planned, only tasks get the source: without the index."""
        own = dict(self.__dict__)
        return own | {"options": {k: v for k, v in self.options.items() if k != "index"}} if self.planned else own

    def schema(self) -> str:
        return INDEX_SCHEMA if self.options.get("mode") == "index" else SCHEMA

    def reader(self, schema) -> CaptureReader:  # noqa: ARG002
        self.planned = True
        return CaptureReader(dict(self.options), self.options.get("mode") == "index")

    def writer(self, schema, overwrite) -> CaptureWriter:  # noqa: ARG002
        return CaptureWriter(self.options["path"])


def _reader(spark: SparkSession, path: str, split_bytes: int):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("path", path).option("splitBytes", str(split_bytes))


def capture_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Of each split: its file, start, frames, damaged stretches, and the
    section and interface blocks it holds."""
    return _reader(spark, path, split_bytes).option("mode", "index").load()


def read_capture(spark: SparkSession, path: str, source: str = "w1", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The frame table of a capture or of a folder's, numbered from 1 on over
    all files in order of their names.

    Reads record headers once more first; what the driver holds of it is a row
    a split.
    """
    known, before, state = [], 0, []
    for row in sorted(capture_index(spark, path, split_bytes).collect(), key=lambda r: (r.path, r.start)):
        if not row.start:
            state = []
        known.append((row.path, row.start, before, [base64.b64encode(b).decode() for b in state]))
        before += row.frames
        for _, block in row.marks:
            state = [*([] if bytes(block[:4]) == SECTION else state), bytes(block)]
    return _reader(spark, path, split_bytes).option("source", source).option("index", json.dumps(known)).load().select(*COLUMNS)


def write_capture(frames: DataFrame, path: str) -> None:
    """``frames`` as captures with radiotap headers, one a task. Frames need a
    time; fields that no header has (EHT rates, names of protocols) are lost."""
    frames.sparkSession.dataSource.register(CaptureSource)
    frames.select(*COLUMNS).where(F.col("epoch_us").isNotNull()).write.format("capture").option("path", path).mode("append").save()
