"""Logs and captured stations: clocks, one station a log, a second ledger."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import binding, roaming, verifier

S = 1_000_000


def commands(spark, rows):
    """(name, seconds) of one capture."""
    return spark.createDataFrame([("c", n, k, round(t * S)) for k, (n, t) in enumerate(rows)], "capture string, name string, line long, cmd_us long")


def air(spark, rows):
    return spark.createDataFrame([("c", s, round(t * S)) for s, t in rows], "capture string, sta string, air_us long")


def scores(spark, log, seen):
    return {(r.name, r.sta): r for r in binding.clock_scores(commands(spark, log), air(spark, seen)).collect()}


def test_a_regular_rhythm_does_not_hide_a_wrong_clock(spark):
    """Roams every 20 s and a clock 187.11 s off: without correction 12 fit,
    the right clock fits all 20."""
    log = [("u", 5000 + 20 * k) for k in range(20)]
    r = scores(spark, log, [("a", t + 187.11) for _, t in log])[("u", "a")]
    assert (r.offset_us, r.matches, r.mad_us, r.hypothesis) == (187.11 * S, 20, 0, 2)


def test_clock_hypotheses(spark):
    rng = random.Random(1)
    log = [("u", 10_000 + 25 * k + 9 * rng.random()) for k in range(12)]
    near = scores(spark, log, [("a", t + 2.744) for _, t in log])[("u", "a")]
    assert (near.offset_us, near.matches, near.hypothesis) == (pytest.approx(2.744 * S, abs=2), 12, 0)
    zone = scores(spark, log, [("a", t + 32_402.5) for _, t in log[:11]])[("u", "a")]
    assert (zone.offset_us, zone.matches, zone.hypothesis) == (pytest.approx(32_402.5 * S, abs=2), 11, 1)
    jitter = scores(spark, log, [("a", t + 0.1 * (k % 3 - 1)) for k, (_, t) in enumerate(log)])[("u", "a")]
    assert jitter.mad_us == pytest.approx(0.1 * S, abs=2) and abs(jitter.offset_us) < 2
    assert scores(spark, log, [("a", 4_000_000.0)])[("u", "a")].matches == 1  # the difference of medians itself


def bind(spark, units, addresses, found):
    u = spark.createDataFrame([("c", n, k, ip) for k, (n, ip) in enumerate(units)], "capture string, name string, ord int, ip string")
    a = spark.createDataFrame([("c", *x) for x in addresses], "capture string, ip string, mac string")
    s = spark.createDataFrame([("c", *x) for x in found], "capture string, name string, sta string, offset_us double, matches long, mad_us double")
    return {r.name: (r.sta, r.method, r.offset_us, r.matches, r.notes) for r in binding.bound(u, a, s).collect()}


def test_each_station_has_one_log(spark):
    found = [("u1", "a", 5.0, 9, 1.0), ("u1", "b", 6.0, 9, 2.0), ("u2", "a", 1.0, 9, 0.5), ("u2", "b", 2.0, 6, 3.0), ("u3", "a", 1.0, 9, 0.1), ("u3", "c", 1.0, 4, 0.1), ("u5", "d", 1.0, 3, 0.1)]
    got = bind(spark, [("u1", None), ("u2", "10.0.0.1"), ("u3", "10.0.0.9"), ("u4", "10.0.0.4"), ("u5", "10.0.0.5")], [("10.0.0.1", "a"), ("10.0.0.4", "x"), ("10.0.0.5", "d")], found)
    assert got == {
        "u1": ("a", "time", 5.0, 9, "no_address"),
        "u2": ("b", "time", 2.0, 6, "address_taken"),
        "u3": (None, None, None, 0, "unmatched"),
        "u4": ("x", "ip", None, 0, "no_clock"),
        "u5": ("d", "ip", 1.0, 3, "few_matches"),
    }


def test_addresses(spark):
    rows = [("c", "10.0.0.1", "b", 5, 1), ("c", "10.0.0.1", "a", 6, 2), ("c", "10.0.0.1,10.0.0.2", "z", 1, 3), ("d", "10.0.0.1", "a", 9, 4), ("c", None, "z", 1, 5), ("c", "10.0.0.3", None, 1, 6)]
    seen = spark.createDataFrame(rows, "capture string, ip_src string, ta string, epoch_us long, number long")
    assert sorted(map(tuple, binding.addresses(seen).collect())) == [("c", "10.0.0.1", "b"), ("d", "10.0.0.1", "a")]


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        for m in range(n, 8):
            for top in (3, 1000):
                w = rng.integers(-top, top, (n, m)).astype(float)
                got = binding.best_assignment(w)
                assert len(set(got.tolist())) == n
                want = max(sum(w[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
                assert w[np.arange(n), got].sum() == want


RANKED = "capture string, name string, ap string, line long, cmd_us long, connected_us long"
SEEN = "capture string, sta string, ap string, assoc_num long, auth_us long, assoc_us long"


def test_scores_by_ranks_and_assignment(spark):
    rng = random.Random(3)
    logs, seen, num = [], [], 0
    for k, (name, sta, hours) in enumerate((("u1", "a", 7), ("u2", "b", 0), ("u3", "c", -3))):
        t = 1000.0
        for i in range(40):
            t += 20 + 15 * rng.random()
            ap = f"ap{rng.randrange(3)}"
            where = "c" if sta != "c" else "d"  # a recording in which no authentication was seen
            logs.append((where, name, ap, 1000 * k + i, round(t * S), round((t + 0.3) * S)))
            if rng.random() < 0.9 and sta != "c":
                num += 1
                seen.append(("c", sta, ap, num, round((t + hours * 3600 + 0.02) * S), round((t + hours * 3600 + 0.05) * S)))
            elif sta == "c":
                num += 1
                seen.append((where, sta, ap, num, None, round((t + hours * 3600 + 0.31) * S)))
    found = binding.rank_scores(spark.createDataFrame(logs, RANKED), spark.createDataFrame(seen, SEEN))
    got = {r.name: (r.sta, r.anchor, r.state, r.offset_us, r.matches) for r in binding.assigned(found).collect()}
    assert {n: v[:3] for n, v in got.items()} == {"u1": ("a", "auth", "bound"), "u2": ("b", "auth", "bound"), "u3": ("c", "assoc", "bound")}
    assert abs(got["u1"][3] - (7 * 3600 + 0.02) * S) < 2 and abs(got["u3"][3] - (-3 * 3600 + 0.01) * S) < 2 and got["u3"][4] == 40


def test_assignment_says_why_not(spark):
    cols = "capture string, name string, sta string, anchor string, offset_us double, matches long, mad_us double"
    rows = [("c", "none", "a", "assoc", 0.0, 0, None), ("c", "two", "a", "assoc", 0.0, 3, 5.0), ("c", "two", "b", "assoc", 0.0, 3, 5.0), ("c", "one", "a", "auth", 7.0, 4, 1.0), ("d", "x", "a", "auth", 1.0, 4, 1.0), ("d", "y", "a", "auth", 1.0, 5, 1.0)]
    got = {(r.capture, r.name): (r.sta, r.state) for r in binding.assigned(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("c", "none"): (None, "no_candidate"), ("c", "two"): (None, "ambiguous"), ("c", "one"): ("a", "bound"), ("d", "x"): (None, "more_logs_than_stations"), ("d", "y"): (None, "more_logs_than_stations")}


STA, AP = [f"02:00:00:00:00:0{k}" for k in range(3)], [f"0a:00:00:00:00:0{k}" for k in range(3)]


def made(spark, seed):
    """Random exchanges: repeats, answers only, old anchors, other APs."""
    rng, rows, t = random.Random(seed), [], 0.0
    for _ in range(400):
        t += rng.choice((0.01, 0.15, 0.3, 1.2, 4.0, 11.0))
        sta, ap, kind = rng.choice(STA), rng.choice(AP), rng.random()
        own = dict(number=len(rows) + 1, epoch_us=round(t * S), subtype=11, ta=sta, ra=ap, eapol_msgnr=None, protocol="802.11")
        if kind < 0.3:
            own |= {"ta": ap, "ra": sta}
        elif kind > 0.9:
            own |= {"subtype": 40, "eapol_msgnr": 4, "protocol": "EAPOL"}
        elif kind > 0.5:
            own |= {"subtype": rng.choice((0, 2, 2))}
        rows.append(own)
    for sta in STA:  # enough data frames to be stations by role too
        rows += [dict(number=len(rows) + k + 1, epoch_us=round((t + 60) * S), subtype=40, ta=sta, ra=AP[0], eapol_msgnr=None, protocol="802.11") for k in range(6)]
    for ap in AP:
        rows.append(dict(number=len(rows) + 1, epoch_us=0, subtype=8, ta=ap, ra="ff:ff:ff:ff:ff:ff", eapol_msgnr=None, protocol="802.11"))
    from framewright.sources.frames import COLUMNS, SCHEMA

    return spark.createDataFrame([tuple({"source": "w1", "bssid": AP[0], "retry": False, "length": 0, **r}.get(c) for c in COLUMNS) for r in rows], SCHEMA)


def test_the_ledger_agrees_with_the_pairing(spark):
    for seed in (1, 2):
        frames = made(spark, seed)
        fields = ("sta", "ap", "assoc_us", "assoc_num", "auth_us", "auth_num", "basis", "gap_us")
        one, two = (sorted(map(tuple, x.select(*fields).collect())) for x in (roaming.pairing(frames), verifier.ledger(frames)))
        assert one == two and len(one) > 80 and {r[6] for r in one} == {"request", "response", None}


def test_usable_addresses(spark):
    rows = [("02:00:00:00:00:01",), ("01:00:5e:00:00:01",), ("00:00:00:00:00:00",), ("02:00:00:00:00",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "m string").select(verifier.usable(F.col("m"))).collect()] == [True, False, False, False, False]


COMPARED = "sta string, ap string, assoc_num long, at_us long, is_slow boolean, slow_basis string, sta_total_ms double"


def test_planted_differences_are_found(spark):
    base = [("s", "p", k, 10 * S * k, False, "total", None) for k in range(1, 7)]
    other = [list(r) for r in base]
    other[0][4] = True
    other[1][3] += 50_000  # still within reach
    other[2][3] += 50_001
    other[3][6] = 120.0
    other[4][1] = "q"
    frame = lambda rows: spark.createDataFrame([tuple(r) for r in rows], COMPARED)
    got = sorted((r.kind, r.found_num or 0, r.own_num or 0, r.fields) for r in verifier.compared(frame(base), frame(other)).collect())
    assert got == [("field_mismatch", 1, 1, "is_slow"), ("field_mismatch", 4, 4, "sta_total_ms"), ("found_only", 3, 0, ""), ("found_only", 5, 0, ""), ("own_only", 0, 3, ""), ("own_only", 0, 5, "")]
    assert verifier.compared(frame(base), frame(base)).count() == 0


def test_correlation_lists_both_sides(spark):
    cmd = spark.createDataFrame([("c", "s", "p", 1, 0, 300_000), ("c", "s", "p", 2, 40_000, 300_000), ("c", "s", "q", 3, 0, 300_000), ("c", "s", "p", 4, 9 * S, 300_000)], "capture string, sta string, bssid string, line long, cmd_us long, total_us long")
    air_ = spark.createDataFrame([("c", "s", "p", 11, 30_000, 60_000), ("c", "s", "p", 12, 250_000, 290_000), ("c", "s", "p", 13, None, 9 * S + 310_000), ("c", "s", "q", 14, 250_001, 260_000)], SEEN)
    got = sorted((r.side, r.line or 0, r.assoc_num or 0, r.residual_us) for r in verifier.correlated(cmd, air_).collect())
    assert got == [("air_only", 0, 14, None), ("both", 1, 11, 30_000), ("both", 2, 12, 210_000), ("both", 4, 13, 10_000), ("log_only", 3, 0, None)]
