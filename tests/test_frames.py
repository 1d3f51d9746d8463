"""Operators over hand-made captures with known results."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.operators import merge, ping, roaming, stats, wired
from framewright.operators.joins import SECOND, asof_backward, islands, overlap_join, range_join
from framewright.sources.frames import COLUMNS, SCHEMA, RAW, selected, typed

AP, STA = "00:11:22:33:44:55", "aa:bb:cc:dd:ee:ff"
BASE = 1_700_000_000_000_000


def capture(spark, rows):
    """Frames from dictionaries; what a row leaves out is null."""
    default = {"source": "w1", "protocol": "802.11", "length": 100, "retry": False, "bssid": AP}
    full = [default | {"number": n + 1} | r for n, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in full], SCHEMA)


def echo(us, ping_seq, reply=False, **more):
    a, b = ("10.0.0.2", "10.0.0.1") if reply else ("10.0.0.1", "10.0.0.2")
    return {"epoch_us": BASE + us, "subtype": 40, "protocol": "ICMP", "ip_src": a, "ip_dst": b, "icmp_type": 0 if reply else 8, "icmp_seq": ping_seq, "icmp_ident": "1", "ta": AP if reply else STA, "ra": STA if reply else AP} | more


@pytest.fixture(scope="module")
def basic(spark):
    """Beacons, one roam and two answered pings."""
    beacon = [{"epoch_us": BASE + t, "subtype": 8, "ta": AP, "ra": P.BROADCAST, "channel_freq": 2412} for t in (0, 100_000)]
    roam = [{"epoch_us": BASE + t, "subtype": s, "ta": a, "ra": b} for t, s, a, b in ((500_000, 11, STA, AP), (510_000, 11, AP, STA), (550_000, 0, STA, AP), (560_000, 1, AP, STA))]
    pings = [echo(1_500_000, 1), echo(1_503_000, 1, True), echo(1_700_000, 2), echo(1_703_000, 2, True)]
    return capture(spark, beacon + roam + pings)


def test_basic_capture(basic):
    got = {r.mac: r.role for r in stats.roles(basic).collect()}
    assert got[AP] == "AP" and got[STA] == "STA"
    found = ping.statuses(basic).orderBy("icmp_seq").collect()
    assert [(r.icmp_seq, r.rtt_us, r.status) for r in found] == [(1, 3000, "matched"), (2, 3000, "matched")]
    roams = roaming.pairing(basic).collect()
    assert [(r.sta, r.ap, r.gap_us, r.basis) for r in roams] == [(STA, AP, 50_000, "request")]


def test_loss_late_and_unanswered_flow(spark):
    rows = [echo(0, 1), echo(1_000, 1, True), echo(1_000_000, 2), echo(2_500_000, 2, True), echo(3_000_000, 3), echo(4_000_000, 4, ip_src="10.0.0.9")]
    got = {r.icmp_seq: (r.status, r.rtt_us) for r in ping.statuses(capture(spark, rows)).collect()}
    assert got == {1: ("matched", 1_000), 2: ("late", 1_500_000), 3: ("loss", None), 4: (None, None)}


def plain_pairs(events, window):
    """The pairing rule restated: first sends, then earliest open request."""
    kept, first = [], {}
    for side, seq, t, n in sorted(events, key=lambda e: (e[2], e[3])):
        last = first.get((side, seq))
        if last is None or t - last >= window:
            first[side, seq] = t
            kept.append((seq, t, 0 if side == "req" else 1, n))
    pairs, waiting = {}, {}
    for seq, t, side, n in sorted(kept):
        live = waiting.setdefault(seq, [])
        live[:] = [x for x in live if t - x[0] <= window]
        if side == 0:
            live.append((t, n))
        elif live:
            t0, m = live.pop(0)
            pairs[m] = (n, t - t0)
    return {n: pairs.get(n, (None, None)) for seq, t, side, n in kept if side == 0}


def test_pairing_agrees_with_the_plain_rule(spark):
    rng = random.Random(5)
    events = [(rng.choice(("req", "rep")), rng.randrange(4), rng.randrange(0, 200 * SECOND, 500_000), n + 1) for n in range(300)]
    frames = capture(spark, [echo(t, seq, side == "rep", number=n) for side, seq, t, n in events])
    got = {r.req_num: (r.rep_num, r.rtt_us) for r in ping.matches(frames).collect()}
    assert got == plain_pairs(events, ping.WINDOW_US)


def test_streaks_need_two_losses_in_a_row(spark):
    lost = [echo(t * SECOND, s) for s, t in ((1, 0), (2, 1), (3, 3), (4, 20))]
    answered = [echo(50 * SECOND, 9), echo(50 * SECOND + 10, 9, True)]
    got = ping.streaks(capture(spark, lost + answered)).collect()
    assert [(r.start_us - BASE, r.end_us - BASE, r.n, r.first_seq, r.last_seq) for r in got] == [(0, 3 * SECOND, 3, 1, 3)]


def test_two_sniffers(spark):
    """One clock 2.5 s behind: its offset, copies and coverage."""
    a = [{"epoch_us": BASE + k * 102_400, "subtype": 8, "ta": AP, "ra": P.BROADCAST, "tsf": 5_000_000 + k * 102_400, "seq": 1000 + k} for k in range(12)]
    a += [echo(2_000_000, 1, seq=2000), echo(2_003_000, 1, True, seq=2001)]
    opaque = {"protocol": "802.11", "ip_src": None, "ip_dst": None, "icmp_type": None, "icmp_seq": None, "icmp_ident": None}
    b = [r | {"source": "w2", "epoch_us": r["epoch_us"] - 2_500_000} for r in a[:12]]
    b += [r | opaque | {"source": "w2", "epoch_us": r["epoch_us"] - 2_510_000} for r in a[12:]]
    a += [{"epoch_us": BASE + 3_000_000, "subtype": 40, "ta": STA, "ra": AP, "seq": 3000}]
    b += [{"epoch_us": BASE + 1_000_000, "subtype": 40, "ta": STA, "ra": AP, "seq": 4000, "source": "w2"}]
    both = capture(spark, a + b)
    offset = merge.tsf_offset(both).collect()
    assert [(r.source, r.pairs, r.offset_us) for r in offset] == [("w2", 12, 2_500_000)]
    kept = merge.dedup(merge.aligned(both)).collect()
    by = [r.sources for r in kept]
    assert len(kept) == 16 and by.count("w1,w2") == 14 and by.count("w1") == 1 and by.count("w2") == 1
    ping_row = next(r for r in kept if r.seq == 2000)
    assert ping_row.source == "w1" and ping_row.ip_src == "10.0.0.1"


def test_alignment_leaves_frames_where_they_are(spark):
    """Two sniffers' frames in four tasks stay in four, not in one a sniffer."""
    rows = [{"epoch_us": BASE + k * 102_400 - late, "subtype": 8, "ta": AP, "tsf": k, "source": w} for k in range(40) for w, late in (("w1", 0), ("w2", 2_500_000))]
    both = capture(spark, rows).repartition(4, "number")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = merge.aligned(both).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len({r.task for r in got}) == 4 and len({r.task for r in got if r.source == "w2"}) > 1
    assert sorted(r.epoch_us for r in got) == sorted(BASE + k * 102_400 for k in range(40) for _ in "ab")


def test_wired_pairs(spark):
    """Five requests a second apart, the third unanswered."""
    rows = [x for s in range(1, 6) for x in ([echo(s * SECOND, s)] + ([echo(s * SECOND + s * 1000, s, True)] if s != 3 else []))]
    got = wired.exchanges(wired.packets(capture(spark, rows))).orderBy("epoch_us").collect()
    assert [r.rtt_us for r in got] == [1000, 2000, None, 4000, 5000]


def test_islands_range_overlap_and_asof(spark):
    rows = spark.createDataFrame([("a", t * SECOND, n) for n, t in enumerate((0, 2, 4, 7, 700, 701))], "k string, t long, n long")
    got = [(r.n, r.island // SECOND) for r in islands(rows, ["k"], ["t", "n"], 2 * SECOND).orderBy("n").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (3, 7), (4, 700), (5, 700)]
    right = rows.select("k", F.col("t").alias("r_us"), F.col("n").alias("m"))
    near = {(r.n, r.m) for r in range_join(rows, right, ["k"], "r_us", -2 * SECOND, 3 * SECOND).collect()}
    times = [0, 2, 4, 7, 700, 701]
    assert near == {(i, j) for i, a in enumerate(times) for j, b in enumerate(times) if -2 <= b - a <= 3}
    marks = spark.createDataFrame([("a", 3 * SECOND, 1), ("a", 600 * SECOND, 2)], "k string, at_us long, v long")
    assert [r.v for r in asof_backward(rows, marks, ["k"], "at_us", "v").orderBy("n").collect()] == [None, None, 1, 1, 2, 2]
    spans = [(0, 5), (3, 40), (41, 60), (60, 61)]
    left = spark.createDataFrame([("g", i, a * SECOND, b * SECOND) for i, (a, b) in enumerate(spans)], "g string, i int, l_start long, l_end long")
    other = left.select("g", F.col("i").alias("j"), F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end"))
    got = sorted((r.i, r.j) for r in overlap_join(left, other, ["g"]).collect())
    assert got == sorted((i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if a[0] <= b[1] and b[0] <= a[1])


def test_typed_fields(spark):
    raw = {c: None for c in RAW} | {"number": "1", "epoch": "1000.5", "retry": "True", "subtype": "0x0028", "protocol": "802.11", "length": "100", "rssi": "-60,-62", "ta": STA.upper(), "vht_mcs": "7", "vht_nss": "2"}
    row = typed(spark.createDataFrame([tuple(raw[c] for c in RAW)], ", ".join(f"{c} string" for c in RAW))).first()
    assert (row.epoch_us, row.retry, row.subtype, row.rssi, row.ta, row.mcs_phy, row.mcs, row.nss) == (1_000_500_000, True, 40, -60, STA, "VHT", 7, 2)


def test_window_is_half_open(basic):
    assert selected(basic, BASE, BASE + 100_000).count() == 1


def test_empty_capture(spark, basic):
    none = basic.where("false")
    for operator in (stats.per_second, stats.roles, ping.statuses, roaming.pairing, roaming.handshakes, merge.dedup):
        assert operator(none).count() == 0


def test_handshake_after_a_roam(spark):
    roam = [{"epoch_us": BASE + t, "subtype": s, "ta": a, "ra": b} for t, s, a, b in ((500_000, 11, STA, AP), (550_000, 0, STA, AP), (560_000, 1, AP, STA))]
    beacon = {"epoch_us": BASE, "subtype": 8, "ta": AP, "ra": P.BROADCAST, "channel_freq": 2412}
    keys = [{"epoch_us": BASE + 560_000 + 10_000 * m, "subtype": 40, "eapol_msgnr": m, "ta": AP if m % 2 else STA, "ra": STA if m % 2 else AP} for m in (1, 2, 3, 4)]
    found = roaming.four_way(capture(spark, [beacon, *roam, *keys])).collect()
    assert [(r.sta, r.ap, r.gap_us, r.shake_us - BASE, r.complete, r.total_us) for r in found] == [(STA, AP, 50_000, 570_000, True, 100_000)]


def test_uniform_sample_ranks_within_slices(spark):
    rng = random.Random(4)
    rows = [{"epoch_us": BASE + rng.randrange(90) * 60 * SECOND} for _ in range(777)]
    frames = capture(spark, rows)
    order = sorted(range(777), key=lambda n: (rows[n]["epoch_us"], n))
    got = stats.uniform_sample(frames)
    assert sorted(r.number for r in got.collect()) == sorted(order[777 - 1 if i == 99 else i * 777 // 100] + 1 for i in range(100))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(__s" in plan and "row_number() windowspecdefinition(epoch_us" not in plan
