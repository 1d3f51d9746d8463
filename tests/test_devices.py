"""Distributions of devices over hand-made captures, and against a plain count."""

import random
from collections import Counter

from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.operators import devices
from framewright.operators.joins import SECOND
from framewright.plans.queries import _semi_anti
from test_frames import AP, BASE, STA, capture

LABELS = {"HE": "HE MCS", "HT": "HT MCS"}


def sent(us, **more):
    return {"epoch_us": BASE + us, "subtype": 40, "ta": STA, "ra": AP, "mcs_phy": "HE", "mcs": 7, "nss": 2} | more


def macs(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "mac string")


def by_device(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_buckets_begin_with_the_device_and_hold_empty_ones(spark):
    rows = [sent(3 * SECOND), sent(4 * SECOND, mcs=3, retry=True), sent(4 * SECOND + 1, mcs=3), sent(5 * SECOND, mcs=None), sent(6 * SECOND, mcs_phy="Legacy", mcs=None, data_rate="6"), sent(33 * SECOND, ta=AP, ra=STA)]
    counts = devices.counted(capture(spark, rows), macs(spark, STA))
    got = by_device(devices.buckets(counts), "device", "start")
    first = BASE // SECOND + 3
    r = got[STA, first]
    assert (r.total, r.retry, r.retry_pct, r.tx_total, r.avg_mcs, r.legacy_pct) == (5, 1, 20.0, 5, 4.3, 20.0)
    assert r.breakdown == "HE MCS3×2, HE MCS7×1, Legacy 6Mbps×1" and r.formats == "HE×3, Legacy×1"
    assert [got[STA, first + k].total for k in (10, 20, 30)] == [0, 0, 1]  # what it was sent counts, but not as sent
    assert (got[STA, first + 30].tx_total, got[STA, first + 30].breakdown, got[STA, first + 10].avg_mcs) == (0, "", None)
    assert got["*", first].total == 5 and got["*", first + 30].tx_total == 1
    assert devices.buckets(counts, cap=29).count() == 0


def test_buckets_of_a_long_span_are_whole(spark):
    rows = [sent(3 * SECOND), sent(5 * SECOND, retry=True), sent(100_007 * SECOND), sent(100_007 * SECOND, epoch_us=None)]
    got = by_device(devices.buckets(devices.counted(capture(spark, rows), macs(spark, STA))), "device", "start")
    first = BASE // SECOND + 3
    assert sorted(got) == sorted((dev, first + 10 * k) for dev in ("*", STA) for k in range(10_001))
    assert {k: (r.total, r.retry) for k, r in got.items() if r.total} == {(dev, first + 10 * k): x for dev in ("*", STA) for k, x in ((0, (2, 1)), (10_000, (1, 0)))}


def test_ties_of_labels_go_to_rate_indices_then_to_the_first(spark):
    rows = [sent(1, mcs_phy=None, mcs=None, data_rate="24"), sent(2, mcs=9), sent(3, mcs=1), sent(4, mcs=5), sent(5, mcs=0), sent(6, mcs=2)]
    (r,) = devices.buckets(devices.counted(capture(spark, rows), macs(spark, STA))).where(f"device = '{STA}'").collect()
    assert r.breakdown == "HE MCS9×1, HE MCS1×1, HE MCS5×1, HE MCS0×1, HE MCS2×1"


def test_peaks_at_their_thresholds(spark):
    part = lambda at, n, k: [sent(at * SECOND + i * (SECOND // 40), retry=i < k) for i in range(n)]
    rows = part(0, 50, 50) + part(10, 60, 5) + part(20, 60, 6) + part(30, 60, 30) + part(40, 60, 12) + part(50, 60, 12)
    got = devices.peaks(devices.counted(capture(spark, rows), macs(spark, STA))).where(f"device = '{STA}'").collect()
    sec = BASE // SECOND
    assert sorted({(r.place, r.start - sec, r.peak_pct) for r in got}) == [(1, 30, 50.0), (2, 40, 20.0), (3, 50, 20.0)]
    assert [(r.sec - sec, r.total, r.retry) for r in sorted(got, key=lambda r: r.sec)[:2]] == [(30, 40, 30), (31, 20, 0)]


def test_peaks_of_a_long_span_are_found(spark):
    part = lambda at, n, k: [sent(at * SECOND + i * (SECOND // 100), retry=i < k) for i in range(n)]
    rows = part(0, 60, 12) + part(30_000, 60, 30) + part(60_000, 60, 20) + part(90_000, 60, 12)
    found = devices.peaks(devices.counted(capture(spark, rows), macs(spark, STA)))
    sec = BASE // SECOND
    for dev in (STA, "*"):
        assert sorted((r.place, r.start - sec, r.total, r.retry) for r in found.collect() if r.device == dev) == [(1, 30_000, 60, 30), (2, 60_000, 60, 20), (3, 0, 60, 12)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()


def test_rates_profiles_and_frames_to_oneself(spark):
    rows = [sent(1, rssi=-40), sent(2, nss=1, retry=True, rssi=-45), sent(3, nss=None), sent(4, ra=STA), sent(5, ta=None, ra=STA, rssi=-10), sent(6, ta=AP, ra=P.BROADCAST, subtype=8, mcs_phy="Legacy", mcs=None, data_rate="1")]
    counts = devices.counted(capture(spark, rows), macs(spark, STA))
    rates = by_device(devices.rates(counts).where(f"device = '{STA}'"), "phy", "key", "nss")
    assert {k: (r.total, r.retry) for k, r in rates.items()} == {("HE", "7", None): (5, 1), ("HE", "7", 2): (3, 0), ("HE", "7", 1): (1, 1)}
    all_ = by_device(devices.profiles(counts), "device")
    own = all_[(STA,)]
    assert (own.total, own.tx_total, own.retry, own.min_rssi, own.max_rssi, own.avg_rssi, own.heard) == (6, 5, 1, -45, -40, -42.5, 2)
    assert (own.types, own.formats) == ("Data×6", "HE×5") and all_[("*",)].types == "Data×5, Management×1" and all_[("*",)].tx_total == 5
    none = devices.counted(capture(spark, rows).limit(0), macs(spark, STA))
    assert all(f(none).count() == 0 for f in (devices.profiles, devices.rates, devices.buckets, devices.peaks))


def test_buckets_equal_a_plain_count(spark):
    rng = random.Random(4)
    rows = [sent(rng.randrange(90 * SECOND), ta=rng.choice([STA, AP, None]), ra=rng.choice([STA, AP, None]), mcs=rng.choice([None, 1, 2, 3]), mcs_phy=rng.choice(["HE", "HT", "Legacy"]), data_rate=rng.choice([None, "6", "54"]), retry=rng.random() < 0.3) for _ in range(600)]
    rows.sort(key=lambda r: r["epoch_us"])
    got = by_device(devices.buckets(devices.counted(capture(spark, rows), macs(spark, STA, AP))), "device", "start")
    for dev in (STA, AP):
        own = [(r, r["ta"] == dev) for end in ("ta", "ra") for r in rows if r[end] == dev]
        began = min(r["epoch_us"] for r, _ in own) // SECOND
        for start in range(began, max(r["epoch_us"] for r, _ in own) // SECOND + 1, 10):
            part = [(r, tx) for r, tx in own if start <= r["epoch_us"] // SECOND < start + 10]
            new, old = Counter(), Counter()
            for r, tx in part:
                if tx and r["mcs_phy"] in LABELS and r["mcs"] is not None:
                    new[f"{LABELS[r['mcs_phy']]}{r['mcs']}"] += 1
                elif tx and r["mcs_phy"] not in LABELS and r["data_rate"]:
                    old[f"Legacy {r['data_rate']}Mbps"] += 1
            have = got[dev, start]
            assert (have.total, have.retry, have.tx_total) == (len(part), sum(r["retry"] for r, _ in part), sum(tx for _, tx in part))
            assert have.breakdown == ", ".join(f"{k}×{n}" for k, n in (new + old).most_common(5))


def test_counts_of_the_whole_capture_are_in_many_tasks(spark):
    rows = [sent(k * SECOND // 10, mcs=k % 8) for k in range(600)]
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        counts = devices.counted(capture(spark, rows), macs(spark, STA))
        assert counts.where("device = '*'").select(F.input_file_name()).distinct().count() > 1
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert counts.where("device = '*'").agg(F.sum("n")).first()[0] == 600


def test_senders_are_counted_before_they_are_told_apart(spark):
    rows = [sent(k, subtype=8, ta=AP, ra=P.BROADCAST) for k in range(3)] + [sent(k, bssid=AP) for k in range(9)]
    found = _semi_anti(capture(spark, rows))
    assert set(map(tuple, found.collect())) == {(STA, 9, "station"), (AP, 3, "other")}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # a list of stations too long to be sent to all
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _semi_anti(capture(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.index("Join LeftSemi") < plan.index("Aggregate")
