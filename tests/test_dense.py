"""Captures that never pause: work stays in short pieces, results stay the same."""

import random

import pandas as pd
from pyspark.sql import functions as F

from framewright.operators import joins, roaming, stations, timesync, verifier

EVENTS = "sta string, ap string, kind string, basis string, subtype int, current_ap string, epoch_us long, number long"


def busy(rng, n):
    """Events of one station, seldom further apart than a second, many at one time."""
    t, out = 0, []
    for k in range(n):
        t += rng.choice((0, 0, 2_000, 150_000, 900_000, 4_000_000 if k % 50 == 0 else 30_000))
        kind = rng.choice(("auth", "auth", "assoc"))
        out.append(("s", f"ap{rng.randrange(2)}", kind, rng.choice(("request", "response")) if kind == "auth" else "request", 11 if kind == "auth" else rng.choice((0, 2)), None, t, k))
    return out


def test_a_station_without_pauses_is_paired_in_pieces(spark):
    rows = busy(random.Random(5), 900)
    events = spark.createDataFrame(rows, EVENTS)
    cut = roaming.pieces(events, F.col("kind") == "assoc").toPandas()
    assert cut.groupby("island").size().max() < 200  # one piece of all before
    names = [c.split()[0] for c in EVENTS.split(", ")]
    want = roaming._paired(pd.DataFrame(rows, columns=names))
    one_by_one = pd.concat([roaming._paired(x) for _, x in cut.groupby("island", sort=True)])
    plain = lambda df: [tuple(None if pd.isna(v) else v for v in r) for r in df.sort_values("assoc_num").itertuples(index=False)]
    assert plain(one_by_one) == plain(want)


def test_the_ledger_agrees_with_the_pairing_on_a_busy_station(spark):
    rows = busy(random.Random(6), 600)
    mac = {"s": "02:00:00:00:00:01", "ap0": "0a:00:00:00:00:01", "ap1": "0a:00:00:00:00:02"}
    ends = lambda r: (mac[r[0]], mac[r[1]]) if r[3] == "request" else (mac[r[1]], mac[r[0]])
    frames = spark.createDataFrame([(*ends(r), r[4], r[6], r[7], None, None) for r in rows], "ta string, ra string, subtype int, epoch_us long, number long, eapol_msgnr int, current_ap string")
    sta = spark.createDataFrame([(mac["s"],)], "sta string")
    key = lambda df: sorted((r.assoc_num, r.auth_us, r.auth_num, r.basis) for r in df.collect())
    assert key(verifier.ledger(frames)) == key(roaming.pairing(frames, sta))


def test_differences_are_counted_as_pairs_are(spark):
    """Dense and sparse times, by places of edges and by pairs."""
    rng = random.Random(7)
    for span, n in ((2_000_000, 300), (400_000_000, 120)):
        left = [("c", f"u{k % 2}", rng.randrange(span) / 2, 1 + k % 3) for k in range(n)]
        air = sorted({rng.randrange(span // 2) // 50_000 * 50_000 if k % 3 else rng.randrange(span // 2) for k in range(4 * n)})
        right = [("c", a, 1 + k % 4) for k, a in enumerate(air)]
        reach, width = 300_000, 1_000 if span > 2_000_000 else 100_000
        want = {}
        for _, u, t, w in left:
            for _, a, c in right:
                if abs(a - t) <= reach:
                    n_, first = want.get((u, int((a - t) / width)), (0, (t, a)))
                    want[(u, int((a - t) / width))] = (n_ + w * c, min(first, (t, a)))
        l, r = spark.createDataFrame(left, "g string, u string, t double, w long"), spark.createDataFrame(right, "g string, air_us long, c long")
        got = {(x.u, x.bucket): (x.n, (x.first.t, x.first.air_us)) for x in joins.difference_counts(l, r, ["g"], ["g", "u"], reach, width).collect()}
        assert got == want
        near = sorted((x.u, x.residual, x.w) for x in joins.nearest_in_time(l, r, ["g"], ["g", "u"], 5_000).collect())
        best = [(u, min(((abs(a - t), a) for _, a, _ in right))[1] - t, w) for _, u, t, w in left]
        assert near == sorted(x for x in best if abs(x[1]) <= 5_000)


def test_copies_in_a_log_and_a_capture_are_counted_not_paired(spark):
    """Forty million pairs, of six times each way."""
    at = lambda shift: spark.range(6 * 2500).select(F.lit("s").alias("sta"), (F.col("id") % 6 * 70_000_000 + shift).alias("x"))
    got = stations.offset_histogram(at(0).withColumnRenamed("x", "cmd_us"), at(120_000).withColumnRenamed("x", "assoc_us")).collect()
    assert [tuple(r) for r in got] == [("s", 1, 6 * 2500 * 2500, 6, 120_000.0, 0.0)]


def test_contacts_and_replies_of_a_busy_minute_meet_once(spark):
    """Against every contact's look at all replies; a group holds rows, not pairs."""
    rng = random.Random(8)
    syncs = [(k, rng.randrange(60) * 50_000) for k in range(300)]
    ntp = [(k, 7, rng.randrange(60) * 50_000 + rng.choice((0, 1)), rng.choice("ab")) for k in range(400)]
    want = []
    for dst in "ab":
        used = set()
        for t, line in sorted((t, n) for n, t in syncs):
            free = [(abs(o - t), o, f) for f, _, o, d in ntp if d == dst and f not in used and abs(o - t) <= 90_000]
            if free:
                _, o, f = min(free)
                used.add(f)
                want.append((dst, line, f, 7 - o, o - t))
    replies = spark.createDataFrame(ntp, "frame_no long, arrival_us long, org_us long, dst string")
    log = spark.createDataFrame(syncs, "line_no long, ts_us long")
    assert sorted(map(tuple, timesync.matches(replies, log, 90_000).collect())) == sorted(want)


def test_commands_and_roams_are_paired_without_their_pairs(spark):
    rng = random.Random(9)
    commands = [("c", "s", f"ap{k % 2}", k, rng.randrange(60) * 40_000, rng.choice((0, 90_000, 30_000_000))) for k in range(150)]
    roams = [("c", "s", f"ap{k % 2}", 1000 + k, rng.randrange(60) * 40_000 if k % 3 else None, rng.randrange(60) * 40_000 + rng.choice((0, 30_000_000))) for k in range(150)]
    made = lambda c, r: verifier.correlated(spark.createDataFrame(c, "capture string, sta string, bssid string, line long, cmd_us long, total_us long"), spark.createDataFrame(r, "capture string, sta string, ap string, assoc_num long, auth_us long, assoc_us long"))
    used, want = set(), {}
    for _, _, ap, line, cmd, total in sorted(commands, key=lambda x: (x[4], x[3])):
        far = [((auth - cmd) if auth is not None else assoc - cmd - total, num) for _, _, of, num, auth, assoc in roams if of == ap and num not in used]
        near = min(((abs(d), num, d) for d, num in far if abs(d) <= verifier.LOG_US), default=None)
        if near:
            used.add(near[1])
            want[line] = near[1:]
    found = made(commands, roams).collect()
    assert {r.line: (r.assoc_num, r.residual_us) for r in found if r.side == "both"} == want
    assert len(found) == len(commands) + len(roams) - len(want) and len(want) > 100
    # 64 million pairs within reach
    many = made([("c", "s", "a", k, k, 5) for k in range(8000)], [("c", "s", "a", k, k, k) for k in range(8000)]).where("side = 'both'")
    assert many.where("line = assoc_num and residual_us = 0").count() == 8000


def test_impact_of_roams_is_summed_without_their_frames(spark):
    """Busy and quiet spells, pauses longer than a window, echoes at its edges."""
    rng = random.Random(11)
    sta, ap = "02:00:00:00:00:01", "0a:00:00:00:00:01"
    blank = dict.fromkeys(("rssi", "ip_src", "ip_dst", "icmp_type", "bssid"))
    rows, t = [], 0
    for k in range(700):
        t += rng.choice((0, 250_000, 500_000, 1_000_000, 3_000_000, 7_500_000 if k % 20 == 0 else 0))
        kind, up = rng.choice(("roam", "echo", "echo", "echo", "data")), rng.random() < 0.5
        row = blank | {"epoch_us": t, "number": k, "ta": sta if up else ap, "ra": ap if up else sta, "retry": rng.random() < 0.3, "rssi": rng.choice((None, -40 - k % 30)), "subtype": 40, "bssid": ap, "current_ap": None}
        if kind == "roam":
            row |= {"subtype": 2, "ta": sta, "ra": ap}
        elif kind == "echo":
            there = f"10.0.0.{rng.randrange(3)}"
            row |= {"icmp_type": 8, "ip_src": "10.0.1.1", "ip_dst": there} if rng.random() < 0.6 else {"icmp_type": 0, "ip_src": there, "ip_dst": "10.0.1.1"}
        rows.append(row)
    rows.append(blank | {"epoch_us": 0, "number": 9999, "ta": ap, "ra": "ff:ff:ff:ff:ff:ff", "retry": False, "subtype": 8, "current_ap": None})
    frames = spark.createDataFrame(rows, "epoch_us long, number long, ta string, ra string, retry boolean, rssi int, subtype int, bssid string, current_ap string, ip_src string, ip_dst string, icmp_type int")
    found = roaming.roam_impact(frames).collect()
    share = lambda x: round(100 * sum(r["retry"] for r in x) / len(x), 2) if x else None
    assert len(found) > 50
    for f in found:
        near = [r for r in rows if abs(r["epoch_us"] - f.start_us) <= roaming.IMPACT_US and r["number"] != 9999]
        before, after = [r for r in near if r["epoch_us"] < f.start_us], [r for r in near if r["epoch_us"] >= f.start_us]
        flows = {}
        for r in near:
            if r["icmp_type"] is not None and (r["icmp_type"] == 0 or not r["retry"]):
                flows.setdefault(r["ip_dst"] if r["icmp_type"] else r["ip_src"], []).append(r["icmp_type"])
        matched = sum(a == 8 and b == 0 for x in flows.values() for a, b in zip(x, x[1:], strict=False))
        lost = sum(x[-1] == 8 for x in flows.values())
        assert (f.before_frames, f.after_frames, f.matched, f.lost) == (len(before), len(after), matched, lost)
        assert (f.before_retry_pct, f.after_retry_pct) == (share(before), share(after))
    # 4000 roams beside 4000 frames: 16 million rows within reach
    many = [blank | {"epoch_us": k, "number": k, "ta": sta, "ra": f"0a:00:00:00:00:{k % 50 + 10}", "retry": k % 2 == 0, "subtype": 2, "current_ap": None} for k in range(4000)]
    data = [blank | {"epoch_us": k, "number": 10_000 + k, "ta": sta, "ra": ap, "bssid": ap, "retry": False, "subtype": 40, "current_ap": None} for k in range(4000)]
    plan = roaming.roam_impact(spark.createDataFrame([*many, *data, rows[-1]], frames.schema))
    assert plan.selectExpr("sum(before_frames + after_frames) s").first().s == 8000 * plan.count() > 8000 * 3000
