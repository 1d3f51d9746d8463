"""Captures made by hand and written ones, whole and cut into splits."""

import glob
import json
import pickle
import struct

import pytest

from framewright.functions.tables import shared_dir
from framewright.plans import queries
from framewright.sources import capture
from framewright.sources.capture import capture_index, read_capture, write_capture

AP, STA = bytes.fromhex("0a0000000001"), bytes.fromhex("020000000003")
AP_, STA_ = AP.hex(":"), STA.hex(":")


def tap(*fields):
    """A radiotap header from (bit, alignment, bytes)."""
    body = b""
    for _, align, data in fields:
        body += bytes(-(8 + len(body)) % align) + data
    return struct.pack("<BBHI", 0, 0, 8 + len(body), sum(1 << b for b, _, _ in fields)) + body


BEACON = tap((0, 8, bytes(8)), (3, 2, struct.pack("<HH", 5180, 0x140)), (5, 1, b"\xc4")) + bytes([0x80, 0, 0, 0]) + b"\xff" * 6 + AP + AP + struct.pack("<H", 77 << 4) + struct.pack("<QHH", 123_456_789, 100, 1)
DEAUTH = tap((1, 1, b"\x10"), (2, 1, b"\x0c")) + bytes([0xC0, 8, 0, 0]) + STA + AP + AP + struct.pack("<H", 5 << 4) + struct.pack("<H", 7) + b"FCS!"
IP = bytes([0x45, 0]) + struct.pack(">HHHBBH", 36, 0, 0, 64, 1, 0) + bytes([10, 0, 0, 3]) + bytes([10, 0, 1, 1])
ECHO = tap((5, 1, b"\xbf"), (21, 2, bytes([0, 0, 0, 0, 0x72, 0, 0, 0, 0, 0, 0, 0]))) + bytes([0x88, 9, 0, 0]) + AP + STA + AP + struct.pack("<H", 9 << 4) + bytes(2) + b"\xaa\xaa\x03\0\0\0\x08\x00" + IP + struct.pack(">BBHHH", 8, 0, 0, 258, 41) + b"pingpong"
ACK = tap() + bytes([0xD4, 0, 0, 0]) + STA
KEY = tap((19, 1, bytes([2, 0, 15]))) + bytes([0x08, 2, 0, 0]) + STA + AP + AP + struct.pack("<H", 3 << 4) + b"\xaa\xaa\x03\0\0\0\x88\x8e" + b"\x01\x03\x00\x5f\x02\x13\xca" + bytes(92)
ARP = tap((23, 2, struct.pack("<6H", 0x20, 0, 11 << 8, 0, 0, 2))) + bytes([0x08, 1, 0, 0]) + AP + STA + AP + struct.pack("<H", 4 << 4) + b"\xaa\xaa\x03\0\0\0\x08\x06" + struct.pack(">HHBBH", 1, 0x800, 6, 4, 2) + bytes(20)
SECRET = tap() + bytes([0x88, 0x41, 0, 0]) + AP + STA + AP + struct.pack("<H", 8 << 4) + bytes(2) + b"\xaa\xaa\x03\0\0\0\x08\x00" + IP
SHORT = tap() + bytes([0x80, 0])
FRAMES = [BEACON, DEAUTH, ECHO, ACK, KEY, ARP, SECRET, SHORT]


def pcap(frames, order="<", magic=0xA1B2C3D4, parts=10**6, link=127):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 262_144, link)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000 + k, k * parts // 1000, len(f), len(f) + 3) + f
    return out


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def section(order, faces, frames):
    """A section: interfaces (link, options), frames (interface, ticks, bytes)."""
    out = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    for link, options in faces:
        out += block(order, 1, struct.pack(order + "HHI", link, 0, 0) + options)
    for face, ticks, f in frames:
        out += block(order, 6, struct.pack(order + "IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def read(spark, path, splits):
    return rows(read_capture(spark, path, split_bytes=splits))


def damaged(spark, path, splits):
    return sum(r.damaged for r in capture_index(spark, path, splits).collect())


@pytest.fixture
def put(tmp_path):
    def write(data, name="a.pcap"):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    return write


def test_fields(spark, put):
    got = {r.number: r for r in read_capture(spark, put(pcap(FRAMES))).collect()}
    have = lambda n: {k: v for k, v in got[n].asDict().items() if v is not None and k not in ("number", "epoch_us", "source", "length")}
    plain = {"protocol": "802.11", "retry": False, "mcs_phy": "Legacy"}
    assert have(1) == plain | {"subtype": 8, "ta": AP_, "ra": "ff:ff:ff:ff:ff:ff", "bssid": AP_, "seq": 77, "tsf": 123_456_789, "channel_freq": 5180, "rssi": -60}
    assert have(2) == plain | {"subtype": 12, "retry": True, "ta": AP_, "ra": STA_, "bssid": AP_, "seq": 5, "reason_code": 7, "data_rate": "6"}
    assert have(3) == {"protocol": "ICMP", "subtype": 40, "retry": True, "ta": STA_, "ra": AP_, "bssid": AP_, "seq": 9, "rssi": -65, "mcs_phy": "VHT", "mcs": 7, "nss": 2, "ip_src": "10.0.0.3", "ip_dst": "10.0.1.1", "icmp_type": 8, "icmp_ident": "258", "icmp_seq": 41}
    assert have(4) == plain | {"subtype": 29, "ra": STA_}
    assert have(5) == {"protocol": "EAPOL", "subtype": 32, "retry": False, "ta": AP_, "ra": STA_, "bssid": AP_, "seq": 3, "mcs_phy": "HT", "mcs": 15, "nss": 2, "eapol_msgnr": 3}
    assert have(6) == {"protocol": "ARP", "subtype": 32, "retry": False, "ta": STA_, "ra": AP_, "bssid": AP_, "seq": 4, "mcs_phy": "HE", "mcs": 11, "nss": 2, "arp_opcode": 2}
    assert have(7) == plain | {"subtype": 40, "ta": STA_, "ra": AP_, "bssid": AP_, "seq": 8}
    assert have(8) == plain | {"subtype": 8}
    assert got[3].epoch_us == 1_700_000_002_002_000 and got[3].length == len(ECHO) + 3


@pytest.mark.parametrize(("order", "magic", "parts"), [("<", 0xA1B2C3D4, 10**6), (">", 0xA1B2C3D4, 10**6), ("<", 0xA1B23C4D, 10**9), (">", 0xA1B23C4D, 10**9)])
def test_orders_and_splits(spark, put, order, magic, parts):
    path = put(pcap(FRAMES * 20, order, magic, parts))
    whole = read(spark, path, 1 << 30)
    assert len(whole) == 160 and [r[0] for r in whole] == list(range(1, 161))
    assert read(spark, path, 5000) == whole
    assert whole == read(spark, put(pcap(FRAMES * 20), "plain.pcap"), 1 << 30)


def test_damage_is_the_same_for_all_cuts(spark, put, monkeypatch):
    data = pcap(FRAMES * 30)
    starts = [24]
    for f in FRAMES * 30:
        starts.append(starts[-1] + 16 + len(f))
    broken = bytearray(data)
    for k in (20, 100, 101, 180):
        broken[starts[k] : starts[k] + 16] = b"\xee" * 16
    broken = bytes(broken[: starts[150]]) + b"garbage, not a record" + bytes(broken[starts[150] : -5])
    path = put(broken)
    whole, lost = read(spark, path, 1 << 30), damaged(spark, path, 1 << 30)
    assert len(whole) == 240 - 5 and lost == 5  # two in a row are one stretch, and the cut end
    for size in (len(broken) // 2 + 1, len(broken) // 8 + 1, starts[100], starts[150] + 7):
        assert read(spark, path, size) == whole and damaged(spark, path, size) == lost


def test_sections_of_either_order(spark, put):
    nanos = struct.pack("<HHBxxx", 9, 1, 9) + bytes(4)
    halves = struct.pack(">HHBxxx", 9, 1, 0x80 | 10) + struct.pack(">HHq", 14, 8, 1_700_000_000) + bytes(4)
    one = section("<", [(127, nanos), (1, b"")], [(0, (1_700_000_000 + k) * 10**9 + 5000, f) for k, f in enumerate(FRAMES * 6)])
    two = section(">", [(105, halves)], [(0, k * 512, BEACON[8:][-36 - 12 :]) for k in range(20)] + [(3, 1, BEACON)])
    path = put(one + two + one, "a.pcapng")
    whole = read(spark, path, 1 << 30)
    assert len(whole) == 48 + 20 + 48 and whole[-1][0] == 48 + 21 + 48
    assert [r[1] for r in whole[:2]] == [1_700_000_000_000_005, 1_700_000_001_000_005]
    assert [r[1] for r in whole[48:50]] == [1_700_000_000_000_000, 1_700_000_000_500_000]
    assert read(spark, path, 3001) == whole and read(spark, path, len(one) + 64) == whole


def test_filters_reach_the_reader(spark, put):
    frames = read_capture(spark, put(pcap(FRAMES * 10)), split_bytes=4000)
    some = frames.where("epoch_us >= 1700000010000000 and epoch_us < 1700000030000000 and subtype in (8, 40)")
    assert rows(some) == [r for r in rows(frames) if 1_700_000_010_000_000 <= r[1] < 1_700_000_030_000_000 and r[3] in (8, 40)]
    reader = capture.CaptureReader({"path": "x"}, False)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    other = EqualTo(("ta",), "x")
    assert list(reader.pushFilters([GreaterThan(("epoch_us",), 5), LessThanOrEqual(("epoch_us",), 9), other, EqualTo(("subtype",), 8)])) == [other]
    assert (reader.low, reader.high, reader.subtypes) == (6, 10, {8})


def test_odd_files(spark, put, tmp_path):
    assert read(spark, put(pcap([]), "none.pcap"), 100) == []
    assert [r[4] for r in read(spark, put(pcap([b"\xff" * 6 + AP + b"\x08\x06" + bytes(6) + b"\0\1" + bytes(20), b"short"], link=1), "wired.pcap"), 1 << 20)] == ["ARP", "Ethernet"]
    assert not capture.has_capture_magic(b"PK\3\4") and capture.has_capture_magic(b"\x0a\x0d\x0d\x0a") and not capture.has_capture_magic(b"\xd4\xc3")
    with pytest.raises(Exception, match="not a capture"):
        read(spark, put(b"text, no capture at all......", "x.txt"), 100)


def test_written_captures_read_back(spark, put, tmp_path):
    frames = read_capture(spark, put(pcap(FRAMES[:6] * 40)))
    out = str(tmp_path / "written")
    write_capture(frames.repartition(3), out)
    fields = [c for c in frames.columns if c not in ("number", "length")]
    assert rows(read_capture(spark, out, split_bytes=2000).select(fields).na.fill(-1)) == rows(frames.select(fields).na.fill(-1))


def test_captures_of_one_task_are_dealt_before_writing(spark, put):
    """Frames that one task reads are written by as many as the session has."""
    one = read_capture(spark, put(pcap(FRAMES[:6] * 20))).coalesce(1)
    before = set(glob.glob(f"{shared_dir(spark)}/captures-*"))
    got = queries._through_captures(one)
    (path,) = set(glob.glob(f"{shared_dir(spark)}/captures-*")) - before
    assert len(glob.glob(f"{path}/*.pcap")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = lambda df: sorted(map(str, df.select(*queries.CARRIED).collect()))
    assert len(key(one)) == 120 and key(got) == key(one)


def test_tasks_do_not_get_the_whole_index(put):
    """A task's reader and source are as small with 5,000 splits as with none."""
    path = put(pcap(FRAMES))
    known = json.dumps([(path, k * 1000, k, []) for k in range(5000)])
    source = capture.CaptureSource({"path": path, "splitbytes": "1000", "index": known})
    assert len(pickle.dumps(source)) > len(known)
    reader = source.reader(None)
    sent = pickle.dumps((reader, source))
    assert len(sent) < 2000
    assert [s.before for s in reader.partitions()] == list(range(len(reader.partitions())))
    assert [b.num_rows for b in pickle.loads(sent)[0].read(reader.partitions()[0])]
