"""Readers over lines as the decoder and the stations write them."""

import pytest
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions import thresholds as L
from framewright.sources import logs
from framewright.sources.frames import COLUMNS, SCHEMA, parsed, selected, union_captures

#: The decoder's 34 cells, each told apart by its value.
LINE = "17\t1700000000.250000\tNov 14, 2023\t1\t0x0028\tICMP\t148\t\t-61,-63\tAA:BB:CC:DD:EE:01\t00:11:22:33:44:02\t00:11:22:33:44:03\t10.0.0.12\t10.0.0.13\t8\t\t0\t0x0018\t1234\t77\t\t\t\t0x0009\t24\t4660\t7\t00:11:22:33:44:27\t5180\t2\t987654321\t1\t0x0002\t3"


def read(spark, *lines, **more):
    return parsed(spark.createDataFrame([(x,) for x in lines], "value string"), **more).collect()


def test_cells_of_a_decoder_line(spark):
    (r,) = read(spark, LINE, source="w2")
    want = {
        "number": 17, "epoch_us": 1_700_000_000_250_000, "source": "w2", "subtype": 40, "protocol": "ICMP", "length": 148, "retry": True,
        "mcs": 9, "mcs_phy": "HE", "nss": 2, "data_rate": "24", "rssi": -61, "ta": "aa:bb:cc:dd:ee:01", "ra": "00:11:22:33:44:02",
        "bssid": "00:11:22:33:44:03", "current_ap": "00:11:22:33:44:27", "ip_src": "10.0.0.12", "ip_dst": "10.0.0.13", "icmp_type": 8,
        "icmp_seq": 77, "icmp_ident": "4660", "arp_opcode": None, "tcp_len": 0, "tcp_flags": "0x0018", "seq": 1234, "reason_code": 7,
        "channel_freq": 5180, "eapol_msgnr": 2, "tsf": 987654321,
    }
    assert r.asDict() == want


@pytest.mark.parametrize(
    ("cells", "phy", "mcs", "nss"),
    [({7: "12"}, "HT", 12, 2), ({20: "32"}, "HT", 32, 1), ({7: "40"}, "HT", 40, None), ({21: "7", 31: "2", 32: "3"}, "VHT", 7, 2), ({22: "5", 33: "4"}, "EHT", 5, 4), ({23: "0x000b", 32: "0x0000"}, "HE", 11, None), ({}, "Legacy", None, None)],
)
def test_rate_and_streams_by_format(spark, cells, phy, mcs, nss):
    line = ["1", "5.0", "", "False", "0x0008", "802.11", "60", *[""] * 27]
    for k, v in cells.items():
        line[k] = v
    (r,) = read(spark, "\t".join([*line[:-1], line[-1] or " "]))
    assert (r.mcs_phy, r.mcs, r.nss) == (phy, mcs, nss)


def test_bad_short_and_padded_lines(spark):
    assert read(spark, "1\t2\t3", "x\t5.0\t\t\t8\tp\t9", "1\tno\t\t\t8\tp\t9", "1\t5.0\t\t\t8\tp\tlong", "") == []
    (r,) = read(spark, "3\t5.5\tt\tTrue\t8\t802.11\t")[:1] or [None]
    assert r is None  # a trailing empty cell is no cell
    (r,) = read(spark, "3\t5.5\tt\tTrue\t8\t802.11\t44")
    assert (r.number, r.subtype, r.length, r.ta, r.tsf) == (3, 8, 44, None, None)


def test_a_decoder_that_lacks_fields(spark):
    fields = ("number", "epoch", "timestamp", "retry", "subtype", "protocol", "length", "ta", "tsf")
    (r,) = read(spark, "3\t5.5\tt\tTrue\t8\t802.11\t44\taa:bb:cc:dd:ee:01\t99", fields=fields)
    assert (r.ta, r.tsf, r.ra) == ("aa:bb:cc:dd:ee:01", 99, None)


def test_pieces_of_a_capture_and_selection(spark):
    row = lambda n, t, **x: tuple(({"number": n, "epoch_us": t, "source": "w1"} | x).get(c) for c in COLUMNS)
    late = spark.createDataFrame([row(1, 30, ta="a", ip_src="p"), row(2, 40, ra="b")], SCHEMA)
    early = spark.createDataFrame([row(3, 10, ra="a"), row(4, 20, ip_dst="p", ta="b"), row(4, 20, ip_dst="p", ta="b")], SCHEMA)
    whole = union_captures([late, early])
    assert [r.epoch_us for r in whole.collect()] == [10, 20, 20, 30, 40]
    assert [r.number for r in selected(whole, macs=["a"]).collect()] == [3, 1]
    assert [r.number for r in selected(whole, macs=["a", "b"], ips=["p"], start_us=20, end_us=30).collect()] == [4, 4]


def test_names_and_types_of_subtypes(spark):
    want = {0: ("AssocReq", "Management"), 14: ("ActionNoAck", "Management"), 6: ("type=6", "Other"), 15: ("type=15", "Other"), 18: ("Trigger", "Control"), 21: ("VHT NDP Ann", "Control"), 24: ("BAR", "Control"), 25: ("BA", "Control"), 26: ("type=26", "Other"), 30: ("CF-End", "Control"), 32: ("Data", "Data"), 36: ("type=36", "Other"), 37: ("VHT NDP Ann", "Control"), 40: ("QoS Data", "Data"), 44: ("QoS Null", "Data")}
    rows = spark.createDataFrame([(k,) for k in want], "code int").select("code", P.subtype_name(F.col("code")).alias("n"), P.frame_type(F.col("code")).alias("t"))
    assert {r.code: (r.n, r.t) for r in rows.collect()} == want


def test_severity_levels(spark):
    cases = [(L.RETRY_PERCENT, L.above, [(5, "good"), (5.1, "warn"), (15, "warn"), (18.3, "danger")]), (L.ROAM_GAP_MS, L.above, [(50, "good"), (80, "warn"), (101, "danger"), (None, "unknown")]), (L.RTT_MS, L.above, [(30, "good"), (50, "warn"), (81, "danger")]), (L.LOSS_PERCENT, L.above, [(1, "good"), (3, "warn"), (5.5, "danger")]), (L.RSSI_DBM, L.below, [(-65, "good"), (-70, "warn"), (-76, "danger")]), (L.MCS, L.below, [(6, "good"), (4, "warn"), (2, "danger")])]
    for levels, by, want in cases:
        rows = spark.createDataFrame([(float(x) if x is not None else None,) for x, _ in want], "x double").select(by(F.col("x"), levels).alias("s"))
        assert [r.s for r in rows.collect()] == [s for _, s in want]


WPA = """2025-03-02 14:21:30.100 wpa_supplicant[info] wlp2: Event SCAN_STARTED (47) received
2025-03-02 14:21:31.250 wpa_supplicant[info] wlp2: Control interface command 'ROAM 06:1B:2c:3D:4e:5f'
2025-03-02 14:21:31.300 wpa_supplicant[info] wlp2: State: COMPLETED -> AUTHENTICATING
no line of a log
2025-03-02 14:21:31.720 wpa_supplicant[info] wlp2: CTRL-EVENT-CONNECTED - Connection to 06:1b:2c:3d:4e:5f completed [id=3 id_str=]
2025-03-02 14:21:40.005 wpa_supplicant[info] wlp2: Event AUTH_TIMED_OUT (13) received
2025-03-02 14:21:41.000 wpa_supplicant[info] wlp2: State: ASSOCIATING -> SCANNING
2025-03-02 14:21:42.500 wpa_supplicant[info] wlp2: State: ASSOCIATED -> INACTIVE"""
KERN = """2025-03-02 14:21:30.090 kernel[alert][7.250000] wlan: wlp2 START SCAN
2025-03-02 14:21:30.180 kernel[warning][7.340000] wlan: SCAN COMPLETED: scanned AP count=4
2025-03-02 14:21:31.900 kernel[alert][9.060000] bridge: wlan IPv4 updated = 0.0.0.0
2025-03-02 14:21:32.050 kernel[alert][9.210000] bridge: wlan IPv4 updated = 10.20.30.40"""
LOGGER = """2025-03-02 14:21:31.200 ROAM[info] [steer.py:12] [wlp2] roaming condition: -71 < -69 (base=-66, trend=falling)
2025-03-02 14:21:31.220 ROAM[info] [steer.py:48] [wlp2] Roam candidate: 06:1b:2c:3d:4e:5f, rssi=-58dB (diff=13dB), load=2.5%, reason=RSSI diff: 13dB, score=130.5
2025-03-02 14:21:31.240 ROAM[warning] [steer.py:71] [wlp2] Roaming: 06:1b:2c:3d:4e:50 → 06:1b:2c:3d:4e:5f, reason=RSSI diff: 13dB, score=130.5
2025-03-02 14:21:33.000 ROAM[info] [wlp2] Roam skipped: just moved
2025-03-02 14:21:34.000 ROAM[info] [wlp2] No suitable roam candidate"""


@pytest.fixture(scope="module")
def station_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, text in (("wpa.log", WPA), ("kern.log", KERN), ("logger.log", LOGGER)):
        (folder / name).write_text(text, encoding="utf-8")
    return {n: str(folder / n) for n in logs.STATION_FILES}


def test_events_of_station_logs(spark, station_files):
    found, warnings = logs.read_station_set(spark, station_files)
    assert warnings == []
    rows = found.orderBy("file", "line").collect()
    got = {f: [(r.event, r.bssid) for r in rows if r.file == f] for f in station_files}
    ap = "06:1b:2c:3d:4e:5f"
    assert got["wpa.log"] == [("roam", ap), ("associating", None), ("connected", ap), ("failed", None), ("failed", None), ("failed", None)]
    assert got["kern.log"] == [("scan_start", None), ("scan_done", None), ("address", None), ("address", None)]
    assert got["logger.log"] == [("condition", None), ("candidate", ap), ("decision", ap), ("skip", None), ("skip", None)]
    by = {r.event: r for r in rows}
    assert (by["condition"].trigger_rssi, by["condition"].trigger_th, by["condition"].trend) == (-71, -69, "falling")
    assert (by["candidate"].rssi, by["candidate"].reason, by["candidate"].score) == (-58, "RSSI diff: 13dB", 130.5)
    assert (by["decision"].from_bssid, by["scan_done"].ap_count, by["scan_done"].mono) == ("06:1b:2c:3d:4e:50", 4, 7.34)
    assert by["roam"].iface == "wlp2" and by["scan_start"].iface is None
    assert logs.station_address(found.withColumn("sta", F.lit("x")), ["sta"]).first().asDict() == {"sta": "x", "sta_ip": "10.20.30.40", "addresses": 1}


def test_absent_and_unknown_station_files(spark, station_files):
    found, warnings = logs.read_station_set(spark, {"kern.log": station_files["kern.log"]})
    assert found.count() == 4 and len(warnings) == 2
    found, warnings = logs.read_station_set(spark, {})
    assert found.count() == 0 and len(warnings) == 3
    with pytest.raises(ValueError):
        logs.read_station_set(spark, {"other.log": "x"})


def test_foreign_logs_clock_records_and_shifts(spark):
    lines = spark.createDataFrame([(x,) for x in ("1700000000.25 eapol timeout", "Nov 14 22:13:21 host daemon: auth ok", "2026-11-14 22:13:22 nothing here", "2023-11-14 22:13:23 link up", "no time", "2026-11-14 22:13:24 Contacted time server 10.0.0.1")], "value string")
    got = logs.merged_logs(lines).collect()
    assert [r.text.split(" ", 1)[1] for r in got] == ["eapol timeout", "22:13:23 link up", "14 22:13:21 host daemon: auth ok"]
    assert logs.merged_logs(lines, limit=1).count() == 1
    assert [r.text for r in logs.sync_events(lines).collect()] == ["2026-11-14 22:13:24 Contacted time server 10.0.0.1"]
    texts = spark.createDataFrame([("Feb 28, 2025 23:59:58.120034777 UTC",), ("Jan  1, 1900 00:00:00.000000000 UTC",), (None,)], "t string")
    assert [r[0] for r in texts.select(logs.ntp_micros(F.col("t"))).collect()] == [1740787198120034, None, None]
    moved = spark.createDataFrame([("2026-07-21 10:00:00.999 a",), ("2026-07-21 10:00:00 b",), ("2026-07-21 10:00:00.1234567 c",), ("bare",)], "value string")
    assert [r.value for r in logs.shifted_lines(moved, 1_500).collect()] == ["2026-07-21 10:00:01.000 a", "2026-07-21 10:00:00 b", "2026-07-21 10:00:00.1249567 c", "bare"]


def test_wired_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("ＯＫ", "2026/07/22 10:00:00", "host", "10.0.0.2", "Time:     1ms", None), ("ＮＧ", "2026/07/22 10:00:01", "host", "10.0.0.2", "Request timed out", "a,\"b\"")], "result string, time string, target string, ip string, status string, remark string")
    logs.write_exping(rows.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, logs.read_exping(spark, str(tmp_path / "out")).fillna("").collect())) == sorted(map(tuple, rows.fillna("").collect()))
    marked = tmp_path / "marked.csv"
    marked.write_bytes(("\ufeff" + ",".join(f'"{h}"' for h in logs.HEADER) + "\r\n" + '"ＯＫ","2026/07/22 10:00:00","h","10.0.0.2","Time:     1ms",""\r\n').encode())
    assert [r.result for r in logs.read_exping(spark, str(marked)).collect()] == ["ＯＫ"]
    (tmp_path / "bad.csv").write_text("a,b,c,d,e,f\n1,2,3,4,5,6\n")
    with pytest.raises(ValueError):
        logs.read_exping(spark, str(tmp_path / "bad.csv"))


def test_results_and_files(spark, tmp_path):
    from framewright.sources import results

    frames = spark.createDataFrame([(5,), (9,)], "epoch_us long")
    rows = spark.createDataFrame([("a", [1, 2], None)], "sta string, refs array<long>, gap long")
    for name in ("one", "two"):
        results.write_result(frames, {"issues": rows, "none": rows.where("false")}, str(tmp_path / name), name)
    assert [tuple(r) for r in results.list_results(spark, str(tmp_path)).collect()] == [(n, ["issues", "none"], 2, 5, 9) for n in ("one", "two")]
    assert [tuple(r) for r in results.read_section(spark, str(tmp_path / "one"), "issues", "sta string, refs array<long>, gap long").collect()] == [("a", [1, 2], None)]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.log").write_text("line")
    (tmp_path / "deep" / "y.txt").write_text("other")
    assert [(r.path.rsplit("/", 2)[1:], r.bytes) for r in results.discovered(spark, str(tmp_path / "deep"), "*.log").collect()] == [(["er", "x.log"], 4)]
