"""Rules that depend on order, over hand-made captures with known results."""

import random

import pandas as pd
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions.tables import kept, release, settled, shared_dir
from framewright.operators import diagnosis, merge, ping, roaming, signals, stations, stats, wired
from framewright.operators.joins import SECOND, by_rank, carried, islands
from framewright.sources import logs
from framewright.sources.frames import COLUMNS
from test_frames import AP, BASE, STA, capture, echo


def test_islands_and_carried_over_chunks_by_a_plain_version(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 4000) * SECOND, n) for n in range(400)]
    frame = spark.createDataFrame(rows, "k string, t long, n long")
    for gap, at_least in ((5 * SECOND, False), (5 * SECOND, True), (700 * SECOND, False)):
        want, last = {}, {}
        for k, t, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            prev = last.get(k)
            begins = prev is None or (t - prev[0] >= gap if at_least else t - prev[0] > gap)
            last[k] = (t, t if begins else prev[1])
            want[n] = last[k][1]
        got = {r.n: r.island for r in islands(frame, ["k"], ["t", "n"], gap, at_least=at_least).collect()}
        assert got == want, (gap, at_least)
    value = F.when(F.col("n") % 3 == 0, F.col("n"))
    for inclusive in (True, False):
        want, last = {}, {}
        for k, t, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            if inclusive and n % 3 == 0:
                last[k] = n
            want[n] = last.get(k)
            if n % 3 == 0:
                last[k] = n
        assert {r.n: r.v for r in carried(frame, ["k"], ["t", "n"], value, "v", inclusive).collect()} == want


def test_values_at_places(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, 7)] + [("b", 3)], "k string, v long")
    got = by_rank(rows, ["k"], "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1})
    assert {r.k: (r.n, r.low, r.mid, r.high) for r in got.collect()} == {"a": (5, 1, 5, 9), "b": (1, 3, 3, 3)}


def test_repeats_of_one_number(spark):
    """First sends are a window from the last kept one, however long a chain is."""
    times = [0, 10, 20, 29, 30, 45, 59, 61, 120]
    found = ping.dedup(capture(spark, [echo(t * SECOND, 7) for t in times])).orderBy("epoch_us").collect()
    assert [(r.epoch_us - BASE) // SECOND for r in found] == [0, 30, 61, 120]


def test_one_sided_flows_and_what_was_seen_of_them(spark):
    asked = [echo(s * SECOND, s) for s in (1, 2, 5)]
    answered = [echo(s * SECOND, s, True, ip_src="10.0.0.9", ip_dst="10.0.0.8") for s in (10, 12)]
    both = [echo(20 * SECOND, 1, ident="2", icmp_ident="2"), echo(20 * SECOND + 5, 1, True, icmp_ident="2"), echo(21 * SECOND, 4, True, icmp_ident="2")]
    frames = capture(spark, [{k: v for k, v in r.items() if k != "ident"} for r in asked + answered + both])
    gaps = ping.gap_losses(frames).collect()
    assert sorted((r.direction, r.missing_seq) for r in gaps) == [("reply", 11), ("request", 3), ("request", 4)]
    seen = sorted((r.direction, r.icmp_seq) for r in ping.observations(frames).collect())
    assert seen == [("reply", 4), ("reply", 10), ("reply", 12), ("request", 1), ("request", 2), ("request", 5)]
    t = ping.totals(frames).first()
    assert (t.pairs, t.losses, t.unmeasurable, t.loss_pct) == (1, 3, 5, 33.33)


def test_loss_basis(spark):
    air = spark.createDataFrame([(8.24,)], "loss_pct double")
    for wire, want in (((10, 0.38, False), (0.38, "wired_ground_truth")), ((0, 0.0, False), (8.24, "wireless_observed")), ((10, 0.38, True), (8.24, "wireless_observed")), ((None, None, None), (8.24, "wireless_observed"))):
        one = spark.createDataFrame([wire], "total long, loss_pct double, partial boolean")
        assert tuple(ping.loss_basis(one, air).first()) == want
    none = spark.createDataFrame([(None,)], "loss_pct double")
    assert tuple(ping.loss_basis(spark.createDataFrame([(None, None, None)], "total long, loss_pct double, partial boolean"), none).first()) == (None, None)


def test_delays_roll_over_the_whole_capture(spark):
    """Two stations' round trips are one line; the slow one stands out of ten."""
    rows = []
    for k in range(30):
        at = k * 10 * SECOND
        rows += [echo(at, k + 1, ta=f"02:00:00:00:00:0{k % 2}"), echo(at + (9000 if k == 20 else 1000), k + 1, True)]
    got = signals.delay_zones(capture(spark, rows)).collect()
    assert [((r.start_us - BASE) // SECOND, r.n, r.max_rtt_us, r.losses) for r in got] == [(200, 1, 9000, 0)]


def test_roam_totals_and_bases(spark):
    slow = roaming.slow_by
    cases = [((151.0, 20.0, 5.0), (True, "sta_log_total")), ((150.0, 500.0, 5.0), (False, "sta_log_total")), ((None, 100.5, None), (True, "total")), ((None, None, 101.0), (True, "gap_lower_bound")), ((None, None, 99.0), (False, None)), ((float("nan"), -1.0, None), (False, None))]
    rows = spark.createDataFrame([c for c, _ in cases], "a double, b double, c double")
    s, b = slow(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in rows.select(s, b).collect()] == [w for _, w in cases]


def test_impact_counts_lost_pings(spark):
    beacon = {"epoch_us": BASE, "subtype": 8, "ta": AP, "ra": P.BROADCAST}
    roam = [{"epoch_us": BASE + 10 * SECOND + t, "subtype": s, "ta": STA, "ra": AP} for t, s in ((0, 11), (50_000, 0))]
    pings = [echo(8 * SECOND, 1), echo(8 * SECOND + 900, 1, True), echo(11 * SECOND, 2), echo(11 * SECOND + 100, 2, retry=True), echo(14 * SECOND, 3)]
    (r,) = roaming.roam_impact(capture(spark, [beacon, *roam, *pings])).collect()
    assert (r.start_us - BASE, r.matched, r.lost, r.problem, r.before_frames) == (10 * SECOND, 1, 1, True, 2)


def test_station_logs_to_decisions_and_episodes(spark):
    at = "2026-07-23 08:50:0{}.000 "
    a, b = "00:80:4c:e1:09:cb", "00:80:4c:e1:09:cc"
    lines = [
        at.format(1) + "ROAM[info] [x] roaming condition: -67 < -65 (base=-65, trend=stable)",
        at.format(2) + "ROAM[info] [x] Roam skipped",
        at.format(3) + f"ROAM[info] [x] Roam candidate: {b}, rssi=-51dB, load=0.0%, reason=better, score=160.0",
        at.format(4) + f"ROAM[warning] [x] Roaming: {a} → {b}, reason=better",
        at.format(4).replace(".000", ".300") + f"ROAM[warning] [x] Roaming: {a} → {b}",
        at.format(4).replace(".000", ".400") + f"wpa_supplicant[info] mlan0: Control interface command 'ROAM {b}'",
        at.format(5) + f"ROAM[warning] [x] Roaming: {a} → {b}",
        at.format(6) + "wpa_supplicant[info] mlan0: State: ASSOCIATING -> SCANNING",
    ]
    events = logs.station_events(logs.station_lines(spark.createDataFrame([(x, n) for n, x in enumerate(lines)], "value string, line long"))).withColumn("sta", F.lit("s"))
    got = stations.roam_decisions(events).orderBy("line").collect()
    assert [(r.line, r.from_bssid, r.bssid, r.condition_us is None, r.candidate_us is None) for r in got] == [(3, a, b, True, False), (6, a, b, True, True)]
    (e,) = stations.wpa_episodes(events).collect()
    assert (e.target, e.ok, e.total_us) == (b, False, None)
    last = stations.last_decision(events.where("event = 'roam'").withColumnRenamed("epoch_us", "cmd_us"), stations.roam_decisions(events)).first()
    assert last.cmd_us - last.decision_us == 400_000


def test_wired_guard_and_cohort(spark):
    rows = [echo(s * SECOND, s, subtype=None) for s in range(1, 5)] + [echo((10 + s) * SECOND, s, subtype=None, ip_src="10.0.0.7") for s in range(3)]
    wire = wired.packets(capture(spark, rows))
    assert wired.sender(wire).first().host == "10.0.0.1"
    assert wired.sender(wired.cohort(wire, BASE + 9 * SECOND, None)).first().host == "10.0.0.7"
    assert wired.sender(wired.cohort(wire, ip_sets=[["10.0.0.7"], ["10.0.0.2"]])).first().host == "10.0.0.7"
    assert wired.wireless_guard(wire).first().verdict == "ok"
    rows[0]["subtype"] = 40
    assert wired.wireless_guard(wired.packets(capture(spark, rows))).first().verdict == "warning"
    assert wired.wireless_guard(wired.packets(capture(spark, [echo(0, 1)]))).first().verdict == "error"


def test_merge_of_one_source_and_its_summary(spark):
    rows = [{"epoch_us": BASE + k * 1000, "subtype": 40, "ta": STA, "seq": k, "source": s} for k in range(5) for s in (("w1", "w2") if k < 2 else ("w1",))]
    found = settled(merge.dedup(capture(spark, rows)), "merged")
    s = merge.summary(found).first()
    assert (s.kept, s.duplicates, s.shared, s.alone) == (5, 2, 2, 3)


def test_merge_holds_however_many_copies_are_open(spark):
    rows = [{"epoch_us": BASE + k * 100 + late, "subtype": 40, "ta": STA, "seq": 7, "source": s} for s, late in (("w1", 0), ("w2", 20_000)) for k in range(100)]
    s = merge.summary(settled(merge.dedup(capture(spark, rows)), "merged")).first()
    assert (s.kept, s.duplicates, s.shared, s.alone) == (100, 100, 100, 0)


def test_merge_of_three_sources_equals_a_plain_search():
    rng = random.Random(8)
    rows = pd.DataFrame([tuple({"epoch_us": rng.randrange(300) * 1000, "source": f"w{rng.randrange(3)}", "number": n, "protocol": "802.11"}.get(c) for c in COLUMNS) for n in range(600)], columns=COLUMNS).assign(k1=[rng.choice("ab") for _ in range(600)], k2=0, k3=0, k4=False)
    want = []
    for _, own in rows.sort_values(["k1", "epoch_us", "source", "number"]).groupby("k1"):
        groups = []
        for t, source in zip(own["epoch_us"], own["source"], strict=True):
            fits = [g for g in groups if source not in g[1] and t - g[0] <= merge.WINDOW_US]
            if fits:
                min(fits, key=lambda g: t - g[0])[1].add(source)
            else:
                groups.append((t, {source}))
        want += [",".join(sorted(g[1])) for g in groups]
    assert list(merge._merged(rows)["sources"]) == want and "w0,w1,w2" in want


def test_conclusions_of_a_quiet_and_a_weak_station(spark):
    beacon = {"epoch_us": BASE, "subtype": 8, "ta": AP, "ra": P.BROADCAST, "rssi": -40}
    quiet, weak = "aa:bb:cc:00:00:01", "aa:bb:cc:00:00:02"
    rows = [beacon] + [{"epoch_us": BASE + k * SECOND, "subtype": 40, "ta": sta, "ra": AP, "rssi": -80 if sta == weak and k == 3 else -50, "retry": sta == weak and k < 4} for k in range(10) for sta in (quiet, weak)]
    got = {(r.sta, r.code): (r.level, r.value, r.refs) for r in diagnosis.conclusions(capture(spark, rows)).collect()}
    assert got == {(quiet, "normal"): ("INFO", 10.0, 10), (weak, "weak_signal"): ("WARNING", -80.0, 1), (weak, "retry_high"): ("WARNING", 40.0, 4)}


def test_texts_and_tables_of_frames(spark):
    stamps = spark.createDataFrame([("Nov 14, 2023 10:11:12.123456789 UTC",), ("no time",)], "t string")
    assert [r[0] for r in stamps.select(P.time_short(F.col("t"))).collect()] == ["10:11:12.123456", "no time"]
    assert stats.categories(capture(spark, [{"epoch_us": BASE, "subtype": 36, "protocol": "mDNS"}])).first()[:2] == ("data", "udp")


def test_kept_tables_go_with_their_files(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    one = kept(spark, ("numbers", "x"), build)
    assert kept(spark, ("numbers", "x"), build).count() == 3 and len(built) == 1
    release(spark, one.inputFiles()[0].rsplit("/", 1)[0].replace("file://", ""))
    assert kept(spark, ("numbers", "x"), build).count() == 3 and len(built) == 2
    assert shared_dir(spark)


def test_kept_tables_follow_their_files(spark, tmp_path):
    """A table derived from files is built anew once they are rewritten."""
    from framewright.functions.tables import kept

    path = str(tmp_path / "events.parquet")
    read = lambda: kept(spark, ("derived", path), lambda: spark.read.parquet(path), path)
    spark.range(3).write.parquet(path)
    assert read().count() == 3
    spark.range(7).write.mode("overwrite").parquet(path)
    assert read().count() == 7
