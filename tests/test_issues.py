"""Rules of issues on hand-made frames at, under and over their thresholds."""

import random
from pathlib import Path

import pytest

from framewright.functions import tables
from framewright.operators import issues, ping, roaming, stats
from framewright.sources.frames import COLUMNS, SCHEMA

S = 1_000_000
STA, AP = "02:00:00:00:00:01", "0a:00:00:00:00:01"
BASE = {"source": "w1", "subtype": 40, "protocol": "802.11", "length": 100, "retry": False, "mcs": 7, "mcs_phy": "HE", "nss": 1, "rssi": -50, "ta": STA, "ra": AP, "bssid": AP}


def table(spark, rows):
    """Frames of (seconds, changes), numbered from 1, and the AP's beacon."""
    rows = [(0.0, {"subtype": 8, "ta": AP, "ra": "ff:ff:ff:ff:ff:ff"}), *rows]
    made = [{**BASE, **own, "number": k + 1, "epoch_us": round(t * S) + 1_000 * S} for k, (t, own) in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in made], SCHEMA)


def found(spark, rows, **more):
    return {(r.scope, r.signal_type, r.category): r for r in issues.issues(table(spark, rows), **more).collect()}


def data(n, start=0.0, step=0.01, **own):
    return [(start + k * step, own) for k in range(n)]


def test_retry_levels_and_evidence(spark):
    quiet = data(190, 0.1) + data(9, 20.0, retry=True)  # 9 of 199 and the beacon that isn't its own: 4.5 %
    assert ("sta", "high_retry", "") not in found(spark, quiet)
    some = found(spark, data(190, 0.1) + data(3, 5.0, retry=True) + data(8, 21.0, retry=True))[("sta", "high_retry", "")]
    assert (some.severity, some.value, some.frame_refs) == ("medium", 5.5, list(range(195, 203)))  # the worst ten seconds
    assert (some.start_us, some.end_us) == (1_021 * S, 1_021 * S + 70_000)
    high = found(spark, data(160, 0.1) + data(40, 21.0, retry=True))
    assert high[("sta", "high_retry", "")].severity == "high" and high[("net", "high_retry", "Retry")].value == pytest.approx(19.9)


def test_weak_signal_takes_the_mean(spark):
    at = data(20, 0.1, rssi=-65)
    assert ("sta", "weak_rssi", "") not in found(spark, at)
    low = found(spark, data(20, 0.1, rssi=-66) + data(2, 3.0, rssi=-60))[("sta", "weak_rssi", "")]
    assert (low.severity, low.value, len(low.frame_refs)) == ("medium", -65.5, 20)
    lower = found(spark, data(20, 0.1, rssi=-78) + data(1, 3.0, rssi=-40))[("sta", "weak_rssi", "")]
    assert (lower.severity, lower.value) == ("high", -76.2)
    one = found(spark, data(200, 0.1) + data(3, 3.0, rssi=-90))  # single weak frames are no issue
    assert ("sta", "weak_rssi", "") not in one


def test_hot_rates(spark):
    base = data(200, 0.1)
    few = found(spark, base + data(29, 5.0, mcs=11, retry=True))
    assert ("sta", "mcs_hotspot", "") not in few
    hot = found(spark, base + data(20, 5.0, mcs=11, retry=True) + data(20, 6.0, mcs=11))[("sta", "mcs_hotspot", "")]
    assert (hot.severity, hot.value, hot.n, len(hot.frame_refs)) == ("medium", 50.0, 40, 20)
    legacy = found(spark, base + data(30, 5.0, mcs=None, mcs_phy="Legacy", data_rate="6", retry=True))[("sta", "mcs_hotspot", "")]
    assert (legacy.severity, legacy.value) == ("high", 100.0)


def test_falls(spark):
    flat = [(k + 0.1, {}) for k in range(40)]
    one = flat + [(5.2, {"rssi": -62})]
    assert ("sta", "signal_cliff", "") not in found(spark, one)  # one of 12 dB
    deep = found(spark, flat + [(5.2, {"rssi": -65})])[("sta", "signal_cliff", "")]
    assert (deep.severity, deep.value) == ("medium", 15.0) and deep.start_us == deep.end_us
    assert found(spark, flat + [(5.2, {"rssi": -71})])[("sta", "signal_cliff", "")].severity == "high"
    assert found(spark, one + [(20.2, {"rssi": -62})])[("sta", "signal_cliff", "")].severity == "medium"


def roam(t, gap=0.02):
    return [(t, {"subtype": 11}), (t + gap, {"subtype": 2, "current_ap": AP})]


def test_roams(spark):
    base = data(20, 0.1)
    quick = [x for k in range(10) for x in roam(10 + 20 * k)]
    assert not [k for k in found(spark, base + quick) if "roaming" in (k[1] or "")]
    often = found(spark, base + quick + roam(300))[("sta", "frequent_roaming", "")]
    assert (often.severity, often.n, len(often.frame_refs)) == ("medium", 11, 22)
    slow = [x for k in range(3) for x in roam(10 + 20 * k, 0.101)]
    got = found(spark, base + slow + quick[6:])
    assert got[("sta", "slow_roaming", "")].value == 3 and ("net", "slow_roaming", "Roaming") not in got
    assert len(got[("sta", "slow_roaming", "")].frame_refs) == 6
    six = found(spark, base + [x for k in range(6) for x in roam(10 + 20 * k, 0.101)])
    assert six[("net", "slow_roaming", "Roaming")].n == 6


def test_losses_zones_anomalies_and_order(spark):
    def echo(t, seq, answered):
        ask = (t, {"protocol": "ICMP", "icmp_type": 8, "icmp_seq": seq, "icmp_ident": "1", "ip_src": "10.0.0.1", "ip_dst": "10.0.1.1"})
        back = (t + 0.003, {"protocol": "ICMP", "icmp_type": 0, "icmp_seq": seq, "icmp_ident": "1", "ip_src": "10.0.1.1", "ip_dst": "10.0.0.1", "ta": AP, "ra": STA})
        return [ask, back] if answered else [ask]

    rows = [x for k in range(40) for x in echo(1.0 + 5 * k, k, k % 8 != 3)]
    rows += [(3.0, {"subtype": 12, "ta": AP, "ra": STA})]
    got = found(spark, rows)
    assert got[("net", "high_loss", "Ping")].value == 12.5 and len(got[("net", "high_loss", "Ping")].frame_refs) == 5
    assert got[("net", "delay_zone", "Delay")].value == 5 and got[("net", "anomaly", "deauth")].severity == "low"
    levels = [r.severity for r in sorted(got.values(), key=lambda r: r.place)]
    assert levels == sorted(levels, key=["high", "medium", "low"].index)
    bound = found(spark, rows, loss=spark.createDataFrame([(5.0,)], "loss_pct double"))
    assert ("net", "high_loss", "Ping") not in bound  # the wire's loss decides, and 5 % is not over


def test_references_are_an_even_sample(spark):
    got = found(spark, data(1000, 0.1, 0.5, rssi=-80))[("sta", "weak_rssi", "")]
    nums = list(range(2, 1002))
    assert got.frame_refs == [nums[i * 10] for i in range(99)] + [nums[-1]]


def test_correlation(spark):
    told = [
        (1, 1, "net", None, "high_loss", [1, 2], 0, 100), (2, 20, "sta", "s", "high_retry", [2, 3], 0, 10), (3, 22, "sta", "s", "signal_cliff", [4], 5, 5),
        (4, 23, "sta", "s", "weak_rssi", [5], 6, 40), (5, 24, "sta", "t", "slow_roaming", [6], 500, 600), (6, 5, "net", None, None, [7], 0, 1000),
    ]
    rows = spark.createDataFrame(told, "place long, rule int, scope string, sta string, signal_type string, frame_refs array<long>, start_us long, end_us long")
    got = {r.title: (r.sta, r.kinds, r.confidence, list(r.frame_refs), r.start_us, r.end_us) for r in issues.causality(rows).collect()}
    # the weak signal shares less than half with the retries and is a group of
    # its own; the loss joins both, and what has no kind takes no part
    assert got == {
        "signal_cliff+high_loss": ("s", "high_loss+high_retry+signal_cliff", 0.9, [2, 3, 4, 1], 0, 100),
        "weak_rssi+high_loss": ("s", "high_loss+weak_rssi", 0.75, [5, 1, 2], 0, 100),
    }


def test_small_rules(spark):
    rows = data(10, 0.1, mcs=15, retry=True) + data(5, 1.0, mcs=3, retry=True) + data(50, 2.0, mcs=15)
    top = stats.top_mcs_share(table(spark, rows)).first()
    assert (top.retries, top.top_retries, top.top_pct, top.leaning) == (15, 10, 66.67, True)
    through = stats.throughput(table(spark, [(0.5, {"subtype": 8, "length": 900}), (0.6, {"length": 0})])).first()
    assert through.peak_mbps == 0.008  # the beacon's 100 bytes and 900
    assert {r.kind: r.level for r in stats.anomalies(table(spark, [(1.0, {"subtype": 10}), *data(3, 2.0, subtype=5), *data(20, 3.0)])).collect()} == {"deauth": "low", "probe": None, "arp": None}
    frames = table(spark, [(10.0, {"subtype": 12, "ta": AP}), (12.0, {"protocol": "EAPOL"}), (11.0, {})])
    points = spark.createDataFrame([(1, 1_011 * S), (2, 1_020 * S)], "number long, epoch_us long")
    assert sorted(map(tuple, roaming.nearest_roaming(points, frames).collect())) == [(1, 1_011 * S, 2, S), (2, 1_020 * S, None, None)]


def test_loss_cause_looks_at_all_frames(spark):
    ask = {"protocol": "ICMP", "icmp_type": 8, "icmp_ident": "1", "ip_src": "10.0.0.1", "ip_dst": "10.0.1.1"}
    back = {"protocol": "ICMP", "icmp_type": 0, "icmp_ident": "1", "ip_src": "10.0.1.1", "ip_dst": "10.0.0.1", "ta": AP, "ra": STA}
    other = {"ta": "02:00:00:00:00:09", "ra": AP}
    rows = [(1.0, ask | {"icmp_seq": 1}), (1.01, back | {"icmp_seq": 1})]
    rows += [(50.0, ask | {"icmp_seq": 2}), *[(50.1 + k / 100, other | {"retry": True}) for k in range(9)]]  # retries of another station
    rows += [(90.0, ask | {"icmp_seq": 3}), (91.9, other | {"protocol": "EAPOL"})]  # its key message
    rows += [(130.0, ask | {"icmp_seq": 4}), (132.0, other | {"protocol": "EAPOL"})]  # two seconds off: too far
    assert [(r.req_num, r.cause) for r in sorted(ping.loss_cause(table(spark, rows)).collect())] == [(4, "high_retry"), (14, "roaming"), (16, "unknown")]


def test_conclusions_without_ground_are_dropped(spark):
    from framewright.operators import diagnosis

    rows = [("kept", [1], 5), ("no frames", [], 5), ("no window", [1], None), ("Cause: TBD", [1], 5), ("이 구간은 추가 조사 필요", [1], 5), ("needs investigation of the AP", [1], 5)]
    told = spark.createDataFrame(rows, "message string, frame_refs array<long>, start_us long")
    assert [r.message for r in diagnosis.grounded(told).collect()] == ["kept"]


def test_samples_of_evidence_order_only_some_slices(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for rule, n, span in ((1, 40, 10**6), (2, 100, 10**7), (3, 101, 1), (4, 5000, 3 * 10**8), (5, 2345, 5 * 10**9), (6, 3000, 60_000)):
        own = sorted((rng.randrange(span), k) for k in range(n))
        rows += [(rule, "", "c", o, number, o + 7) for o, number in own]
        places = range(n) if n <= issues.REFS else sorted({i * n // issues.REFS for i in range(issues.REFS - 1)} | {n - 1})
        want[rule] = ([own[p][1] for p in places], own[0][0] + 7, own[-1][0] + 7)
    got = issues._sampled(spark.createDataFrame(rows, "rule int, sta string, category string, o long, number long, epoch_us long"))
    assert {r.rule: (r.frame_refs, r.start_us, r.end_us) for r in got.collect()} == want
    base = Path(tables.shared_dir(spark))
    assert spark.read.parquet(str(max(base.glob("sampled-slices-*"), key=lambda p: p.stat().st_mtime))).where("rule = 5").count() <= issues.REFS
