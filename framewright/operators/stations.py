"""Station logs beside the capture: episodes, scans, binding, attachment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, asof_backward, carried, difference_counts, islands, range_join, slices, times

# Search reach, coarse pause, tolerance, least matches, bucket.
SEARCH_US, TOLERANCE_US, LEAST_MATCHES, COARSE_US = 30 * SECOND, 250_000, 5, 100_000
DECISION_US, REPEAT_US = 1_000, 500_000
TERMINAL = ("connected", "failed", "roam")
ORDER = ["epoch_us", "line"]


def wpa_episodes(log: DataFrame, keys: tuple[str, ...] = ("sta",), more: tuple[str, ...] = ()) -> DataFrame:
    """Each roam command with what ended it: connected, failed, or another.

    Time runs backwards over the log for "the next terminal event", as an
    as-of look-back over negated time. ``keys`` tell logs apart; columns
    ``more`` of a command go along.
    """
    rows = log.where(F.col("event").isin(*TERMINAL)).select(*keys, *more, (-F.col("epoch_us")).alias("back"), (-F.col("line")).alias("backline"), "epoch_us", "event", "bssid")
    ahead = carried(rows, list(keys), ["back", "backline"], F.struct("event", "epoch_us"), "next", inclusive=False)
    found = ahead.where("event = 'roam'")
    done = F.col("next.event") == "connected"
    return found.select(*keys, *more, F.col("epoch_us").alias("cmd_us"), F.col("bssid").alias("target"), F.coalesce(done, F.lit(False)).alias("ok"), F.when(done, F.col("next.epoch_us") - F.col("epoch_us")).alias("total_us"))


def scan_pairs(log: DataFrame) -> DataFrame:
    """Scans: a completion right after a start; others are orphans."""
    rows = log.where(F.col("event").isin("scan_start", "scan_done"))
    before = carried(rows, ["sta"], ORDER, F.struct("event", "epoch_us"), "before", inclusive=False)
    started = F.when(F.col("before.event") == "scan_start", F.col("before.epoch_us"))
    return before.where("event = 'scan_done'").select("sta", started.alias("start_us"), F.col("epoch_us").alias("done_us"), started.isNull().alias("orphan"))


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    """Decisions but for those told again, by runs of stations."""
    keep, held = [], None
    line = rows.sort_values(["sta", "epoch_us", "line"])
    for r in line.itertuples(index=False):
        again = held is not None and held[:3] == (r.sta, r.from_bssid, r.bssid) and r.epoch_us - held[3] <= REPEAT_US
        keep.append(not again)
        if not again:
            held = (r.sta, r.from_bssid, r.bssid, r.epoch_us)
    return line[keep][["sta", "line"]]


def roam_decisions(log: DataFrame) -> DataFrame:
    """Decisions with the last condition and candidate since a reset.

    A decision consumes what came before it and a skip clears it. The same
    roam told again within half a second of the last one kept is dropped and
    consumes nothing.
    """
    rows = log.where(F.col("event").isin("condition", "candidate", "decision", "skip"))
    told = rows.where("event = 'decision'").select("sta", "from_bssid", "bssid", *ORDER)
    runs = islands(told, ["sta"], ORDER, REPEAT_US)
    kept = slices(runs, ["sta"]).applyInPandas(_once, "sta string, line long").withColumn("kept", F.lit(True))
    rows = settled(rows.join(kept, ["sta", "line"], "left"), "decisions")
    reset = F.when((F.col("event") == "skip") | F.col("kept"), F.struct(*ORDER))
    cut = carried(rows, ["sta"], ORDER, reset, "since", inclusive=False)
    for kind in ("condition", "candidate"):
        cut = carried(cut, ["sta"], ORDER, F.when(F.col("event") == kind, F.struct(*ORDER)), kind, inclusive=False)
    fresh = lambda c: F.when(F.col("since").isNull() | (F.col(c) > F.col("since")), F.col(c)["epoch_us"])
    return cut.where("kept").select("sta", "from_bssid", "bssid", "epoch_us", "line", fresh("condition").alias("condition_us"), fresh("candidate").alias("candidate_us"))


def last_decision(commands: DataFrame, decisions: DataFrame) -> DataFrame:
    """For each roam command, when the last decision before it was made.

    A decision may be up to a millisecond after the command. ``commands``:
    sta, cmd_us, line.
    """
    cmd = commands.select("sta", (F.col("cmd_us") + DECISION_US).alias("t"), "line")
    made = decisions.select("sta", F.col("epoch_us").alias("at"), F.col("epoch_us").alias("decision_us"))
    return asof_backward(cmd, made, ["sta"], "at", "decision_us", strict=True).select("sta", (F.col("t") - DECISION_US).alias("cmd_us"), "line", "decision_us")


def last_scan(log: DataFrame) -> DataFrame:
    """For each roam command, when the last scan before it was done."""
    cmd = log.where("event = 'roam'").select("sta", F.col("epoch_us").alias("t"), "line")
    done = scan_pairs(log).where("not orphan").select("sta", F.col("done_us").alias("at"), F.col("done_us").alias("scan_us"))
    return asof_backward(cmd, done, ["sta"], "at", "scan_us", strict=True).select("sta", F.col("t").alias("cmd_us"), "line", "scan_us")


def offset_histogram(episodes: DataFrame, roams: DataFrame) -> DataFrame:
    """Differences of log and capture roams in tenths of a second, and MAD.

    The commonest tenth and its neighbours give a coarse median; pairs within
    three seconds of it refine it. One row a station.
    """
    cmd = settled(times(episodes, ["sta"], "cmd_us", "w").withColumnRenamed("cmd_us", "t"), "log-times")
    air = settled(times(roams.select("sta", F.col("assoc_us").alias("air_us")), ["sta"], "air_us", "c"), "air-times")
    counts = difference_counts(cmd, air, ["sta"], ["sta"], SEARCH_US, COARSE_US)
    mode = settled(counts.groupBy("sta").agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("mode"), F.max("n").alias("votes")), "modes")
    d = F.col("air_us") - F.col("own")
    tenth = (d / COARSE_US).cast("long")  # towards zero
    around = cmd.join(mode, "sta").withColumn("own", F.col("t")).withColumn("t", F.col("t") + F.col("mode") * COARSE_US)
    near = range_join(around, air, ["sta"], "air_us", -2 * COARSE_US, 2 * COARSE_US).where((F.abs(d) <= SEARCH_US) & (F.abs(tenth - F.col("mode")) <= 1))
    spread = near.groupBy("sta", "mode", "votes", d.alias("d")).agg(F.sum(F.col("w") * F.col("c")).alias("n"))
    coarse = settled(spread.groupBy("sta").agg(F.percentile("d", 0.5, F.col("n")).alias("coarse"), F.max("mode").alias("mode"), F.max("votes").alias("votes")), "coarse")
    moved = cmd.join(coarse, "sta").withColumn("own", F.col("t")).withColumn("t", F.col("t") + F.col("coarse"))
    pairs = range_join(moved, air, ["sta"], "air_us", -3 * SECOND, 3 * SECOND).where(F.abs(d) <= SEARCH_US)
    best = settled(pairs.groupBy("sta", F.col("own").alias("t")).agg(F.min(F.struct(F.abs(d - F.col("coarse")).alias("off"), d.alias("d"))).alias("b"), F.max("mode").alias("mode"), F.max("votes").alias("votes")), "best")
    mid = best.groupBy("sta").agg(F.median("b.d").alias("offset"), F.max("mode").alias("mode"), F.max("votes").alias("votes"), F.count("*").alias("matches"))
    mad = best.join(mid.select("sta", "offset"), "sta").groupBy("sta").agg(F.median(F.abs(F.col("b.d") - F.col("offset"))).alias("mad"))
    return mid.join(mad, "sta").where(F.col("matches") >= LEAST_MATCHES).select("sta", "mode", "votes", "matches", F.round("offset", 3).alias("offset_us"), F.round("mad", 3).alias("mad_us"))


def bind_addresses(frames: DataFrame) -> DataFrame:
    """The commonest sender of each single address: ip, mac, frames."""
    seen = frames.where(F.col("ip_src").isNotNull() & ~F.col("ip_src").contains(",") & F.col("ta").isNotNull()).groupBy(F.col("ip_src").alias("ip"), F.col("ta").alias("mac")).agg(F.count("*").alias("n"))
    return seen.groupBy("ip").agg(F.max_by("mac", F.struct("n", "mac")).alias("mac"), F.max("n").alias("n"))


def _attached(rows: pd.DataFrame) -> pd.DataFrame:
    """One-to-one pairs of runs of a station, the smallest residual first."""
    used: set[tuple[str, int]] = set()
    out = []
    for r in rows.assign(a=rows["residual_us"].abs()).sort_values(["a", "cmd_us", "assoc_num"]).itertuples(index=False):
        if ("c", r.line) not in used and ("a", r.assoc_num) not in used:
            used |= {("c", r.line), ("a", r.assoc_num)}
            out.append((r.sta, r.line, r.cmd_us, r.assoc_num, r.residual_us))
    return pd.DataFrame(out, columns=["sta", "line", "cmd_us", "assoc_num", "residual_us"])


def attach(commands: DataFrame, roams: DataFrame, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """Roam commands and captured roams of one AP within the tolerance.

    ``commands``: sta, bssid, cmd_us (on the capture's clock), line. A roam
    begins with its authentication, if one was seen. Candidates further apart
    than two tolerances share no row, so greedy choice runs in short pieces.
    """
    cmd = commands.select("sta", F.col("bssid").alias("ap"), F.col("cmd_us").alias("t"), "line")
    air = roams.select("sta", "ap", F.coalesce("auth_us", "assoc_us").alias("air_us"), "assoc_num")
    near = range_join(cmd, air, ["sta", "ap"], "air_us", -tolerance_us, tolerance_us)
    near = near.select("sta", F.col("t").alias("cmd_us"), "line", "assoc_num", (F.col("air_us") - F.col("t")).alias("residual_us"))
    runs = islands(near, ["sta"], ["cmd_us", "line", "assoc_num"], 2 * tolerance_us)
    return slices(runs, ["sta"]).applyInPandas(_attached, "sta string, line long, cmd_us long, assoc_num long, residual_us long")


def summary(episodes: DataFrame) -> DataFrame:
    """Of each station: commands, failures, median time to connect."""
    return episodes.groupBy("sta").agg(F.count("*").alias("commands"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("long").alias("failures"), F.round(F.median("total_us"), 3).alias("p50_us"))


