import hashlib
import random
import zlib

from pyspark.sql import functions as F

from framewright.llm import transport
from framewright.llm.queries import op4_transport


def test_round_trip_and_marks():
    rng = random.Random(1)
    for n in (0, 1, 175, 176, 177, 184, 192, 1919, 1920, 1921, 1920 * 16, 1920 * 40 + 7):
        data = rng.randbytes(n)
        media = transport.mux(data)
        found = transport.demux(media)
        assert len(media) % 188 == 0 and found["payload"] == data and found["errors"] == 0
        assert found["units"] == -(-n // 1920) and found["stream_type"] == 6
        assert found["pts"] == [k * 21600 for k in range(found["units"])]
        assert found["access"] == [k % 16 == 0 for k in range(found["units"])]


def test_timestamps_beyond_32_bits():
    for t in (0, 1, 2**30, 2**32 + 12345, 2**33 - 1):
        p = transport._pts(t)
        assert (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 == t


def test_damage_is_counted():
    media = transport.mux(bytes(range(256)) * 40)
    lost = media[: 188 * 5] + media[188 * 6 :]
    assert transport.demux(lost)["errors"] > 0
    torn = bytearray(media)
    torn[188 * 4] = 0
    assert transport.demux(bytes(torn))["errors"] > 0
    table = bytearray(media)
    table[8] ^= 1
    assert transport.demux(bytes(table))["errors"] > 0
    for junk in (b"", b"abc", b"\x47" * 188, b"\x47" + b"\xff" * 187, media[:100]):
        assert transport.demux(junk)["payload"] == b""


def packet(media, k):
    return media[188 * k : 188 * k + 188]


def test_duplicates_and_announced_jumps():
    data = random.Random(2).randbytes(7680)
    media = transport.mux(data)
    n = len(media) // 188
    whole = transport.demux(media)
    for k in range(n):
        twice = media[: 188 * (k + 1)] + packet(media, k) + media[188 * (k + 1) :]
        found = transport.demux(twice)
        assert found["payload"] == data and found["errors"] == 0 and found["pts"] == whole["pts"], k
        thrice = media[: 188 * (k + 1)] + packet(media, k) * 2 + media[188 * (k + 1) :]
        assert transport.demux(thrice)["errors"] > 0, k
    clocked = next(k for k in range(n) if packet(media, k)[3] & 0x20 and packet(media, k)[5] & 0x10)
    other = bytearray(packet(media, clocked))
    other[6] ^= 0xFF
    assert transport.demux(media[: 188 * (clocked + 1)] + bytes(other) + media[188 * (clocked + 1) :])["payload"] == data
    changed = bytearray(packet(media, 5))
    changed[100] ^= 1  # the same counter, other content: an error
    assert transport.demux(media[: 188 * 6] + bytes(changed) + media[188 * 6 :])["errors"] > 0
    # The stream's counters jump where a packet with an adaptation field says so.
    jumped, after = bytearray(media), False
    for k in range(n):
        if packet(media, k)[1:3] in (b"\x41\x00", b"\x01\x00"):
            after = after or k > clocked and bool(packet(media, k)[3] & 0x20 and packet(media, k)[4])
            if after:
                jumped[188 * k + 3] = packet(media, k)[3] & 0xF0 | (packet(media, k)[3] + 5 & 15)
    assert after and transport.demux(bytes(jumped))["errors"] == 1
    first = next(k for k in range(clocked + 1, n) if jumped[188 * k + 3] != media[188 * k + 3])
    jumped[188 * first + 5] |= 0x80
    assert transport.demux(bytes(jumped))["errors"] == 0 and transport.demux(bytes(jumped))["payload"] == data


def plain_reader(media):
    """Packet by packet: tables, elementary packets, timestamps, access points."""
    parts, tables, pes, pts, access = [media[i : i + 188] for i in range(0, len(media), 188)], {}, [], [], []
    for p in parts:
        assert p[0] == 0x47
        pid, start, control = (p[1] & 31) << 8 | p[2], p[1] & 64, p[3] >> 4 & 3
        field = p[5 : 5 + p[4]] if control & 2 else b""
        body = p[4 + (1 + p[4] if control & 2 else 0) :] if control & 1 else b""
        if pid == 0:
            section = body[1 + body[0] :]
            tables["pmt"] = int.from_bytes(section[10:12]) & 0x1FFF
        elif pid == tables["pmt"]:
            section = body[1 + body[0] :]
            at = 12 + (int.from_bytes(section[10:12]) & 0xFFF)
            tables["es"] = int.from_bytes(section[at + 1 : at + 3]) & 0x1FFF
        elif pid == tables["es"]:
            if start:
                pes.append(b"")
                access.append(bool(field and field[0] & 0x40))
            pes[-1] += body
    for k, unit in enumerate(pes):
        assert unit[:3] == b"\0\0\1" and len(unit) == 6 + int.from_bytes(unit[4:6])
        bits = f"{int.from_bytes(unit[9:14]):040b}"
        pts.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        pes[k] = unit[9 + unit[8] :]
    return b"".join(pes), len(parts), pts, access


def test_query_by_a_plain_reader(spark, odd, tmp_path):
    odd.select("doc_id", "text", F.lit("x").alias("n_bytes"), F.lit(1).alias("feature")).write.parquet(str(tmp_path / "documents.parquet"))
    for d in ("/root/testdata/sf0.001", str(tmp_path)):
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        got = op4_transport(spark, d).collect()
        assert len(got) == len(docs)
        want = {}
        for r in docs:
            text = (r.text or "").encode()
            padded = text + b" " * (-len(text) % 192 or (0 if text else 192))
            media = transport.mux(padded)
            payload, packets, pts, access = plain_reader(media)
            assert payload == padded
            n = len(payload)
            mean = sum(payload) * 1000 // n
            var = sum(b * b for b in payload) * 1000 // n - mean * mean // 1000
            cross = sum((a > 127) != (b > 127) for a, b in zip(payload, payload[1:]))
            feature = f"packets={packets};units={len(pts)};access={sum(access)};errors=0;span={pts[-1] - pts[0]};mean={mean};var={var};crossings={cross}"
            want.setdefault(r.doc_id, []).append((len(text), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        for r in got:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) in want[r.doc_id]


def test_crc_of_the_standard():
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_columns(odd, none):
    col = F.col("text").cast("binary")
    got = odd.select("text", transport.demuxed(transport.muxed(col)).alias("r")).select("text", "r.*").collect()
    assert len(got) == odd.count()
    assert all(bytes(r.payload) == (r.text or "").encode() and r.errors == 0 for r in got)
    assert none.select(transport.demuxed(transport.muxed(col))).count() == 0
