"""Signal drops, delays, retry bursts and rate fallback."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, carried, islands, numbered, overlap_join, slices
from framewright.operators.ping import statuses
from framewright.operators.roaming import pairing
from framewright.operators.stats import one_if, per_second, rssi_buckets

# Seconds of signal needed, drop in dB and its reach in seconds,
# rows of the rolling window, pause between delayed rows, least retries of a
# burst and frames it looks ahead.
LEAST_BUCKETS, DROP_DB, DROP_SEC = 10, 10, 5
ROLLING, ZONE_US = 10, 2 * SECOND
BURST, AHEAD = 3, 50
#: Ranks that one window over the capture spans.
RANKS = 100_000


def _cliffs(rows: pd.DataFrame) -> pd.DataFrame:
    """Drops of runs of a sender's seconds."""
    line = rows.sort_values("sec")
    sec, low, high = line["sec"].tolist(), line["min_rssi"].tolist(), line["max_rssi"].tolist()
    found, i = [], 0
    while i < len(sec):
        j = i + 1
        while j < len(sec) and sec[j] - sec[i] <= DROP_SEC:
            if high[i] - low[j] >= DROP_DB:
                found.append((sec[i], high[i], low[j], sec[j] - sec[i]))
                i = j
                break
            j += 1
        i += 1
    inner, k = [], -1
    for s, lo, hi in zip(sec, low, high, strict=True):
        while k + 1 < len(found) and found[k + 1][0] <= s:
            k += 1
        if hi - lo >= DROP_DB and not (k >= 0 and found[k][0] + found[k][3] >= s):
            inner.append((s, hi, lo, 0))
    out = pd.DataFrame(sorted(found + inner), columns=["sec", "before", "after", "took_sec"])
    return out.assign(ta=line["ta"].iloc[0])[["ta", "sec", "before", "after", "took_sec"]]


def cliffs(frames: DataFrame) -> DataFrame:
    """Falls of 10 dB within five seconds, and within one second.

    The scan skips past each fall it reports, which restarts at pauses beyond
    its reach; runs are cut there.
    """
    buckets = rssi_buckets(frames).select("ta", "sec", "min_rssi", "max_rssi")
    enough = buckets.groupBy("ta").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_BUCKETS)
    runs = islands(buckets.join(enough, "ta", "left_semi").withColumn("us", F.col("sec") * SECOND), ["ta"], ["us"], DROP_SEC * SECOND)
    return slices(runs, ["ta"]).applyInPandas(_cliffs, "ta string, sec long, before int, after int, took_sec long")


def cliff_pairs(frames: DataFrame) -> DataFrame:
    """Without skipping: each second with its deepest fall within reach."""
    b = rssi_buckets(frames).select("ta", "sec", "min_rssi", "max_rssi")
    over = Window.partitionBy("ta").orderBy("sec").rangeBetween(1, DROP_SEC)
    fall = F.col("max_rssi") - F.min("min_rssi").over(over)
    return b.withColumn("drop_db", fall).where(F.col("drop_db") >= DROP_DB).select("ta", "sec", "drop_db")


def high_delays(found: DataFrame) -> DataFrame:
    """Answered pings that are slow against the last ten of the capture.

    A round trip is high at twice the rolling mean, or two deviations above
    it. The rolling window runs over ranks, whose chunks each see the last
    rows of the one before.
    """
    rtt = found.where("rtt_us is not null").select("epoch_us", F.lit("").alias("source"), F.col("req_num").alias("number"), "rtt_us")
    ranked = numbered(rtt)
    chunk = F.floor(F.col("rank") / RANKS)
    both = F.when(F.pmod("rank", F.lit(RANKS)) > RANKS - ROLLING, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    over = Window.partitionBy("at").orderBy("rank").rowsBetween(-(ROLLING - 1), 0)
    rolled = ranked.select("*", F.explode(both).alias("at")).withColumns({"avg": F.avg("rtt_us").over(over), "std": F.coalesce(F.stddev_samp("rtt_us").over(over), F.lit(0.0))})
    high = (F.col("rtt_us") > 2 * F.col("avg")) | ((F.col("std") > 0) & (F.col("rtt_us") > F.col("avg") + 2 * F.col("std")))
    return rolled.where((F.col("at") == chunk) & high).select("epoch_us", F.col("number").alias("req_num"), "rtt_us")


def delay_zones(frames: DataFrame) -> DataFrame:
    """Stretches of slow or lost pings of the whole capture.

    Points no more than two seconds apart are one zone.
    """
    found = statuses(frames)
    lost = found.where("status = 'loss'").select("epoch_us", "req_num", F.lit(None).cast("long").alias("rtt_us"))
    points = high_delays(found).unionByName(lost).withColumn("g", F.lit(0))
    runs = islands(points, ["g"], ["epoch_us", "req_num"], ZONE_US)
    return runs.groupBy(F.col("island").alias("start_us")).agg(F.max("epoch_us").alias("end_us"), F.count("*").alias("n"), F.max("rtt_us").alias("max_rtt_us"), F.round(F.avg("rtt_us"), 6).alias("avg_rtt_us"), one_if(F.col("rtt_us").isNull()).alias("losses"))


def delay_causes(frames: DataFrame) -> DataFrame:
    """Delay zones with their cause: roaming nearby, retries, or unknown."""
    zones = settled(delay_zones(frames), "zones").withColumn("g", F.lit(0))
    roams = pairing(frames).select(F.lit(0).alias("g"), F.coalesce("auth_us", "assoc_us").alias("r_start")).withColumn("r_end", F.col("r_start"))
    reach = zones.select("g", "start_us", (F.col("start_us") - ZONE_US).alias("l_start"), (F.col("end_us") + ZONE_US).alias("l_end"))
    near = overlap_join(reach, roams, ["g"]).select("start_us").distinct().withColumn("roam", F.lit(True))
    secs = per_second(frames, 0).select(F.lit(0).alias("g"), (F.col("sec") * SECOND).alias("r_start"), (F.col("sec") * SECOND).alias("r_end"), "total", "retry")
    whole = zones.select("g", "start_us", (F.floor(F.col("start_us") / SECOND) * SECOND).alias("l_start"), (F.floor(F.col("end_us") / SECOND) * SECOND + SECOND).alias("l_end"))
    load = overlap_join(whole, secs, ["g"]).groupBy("start_us").agg((F.sum("retry") / F.sum("total")).alias("ratio"))
    found = zones.drop("g").join(near, "start_us", "left").join(load, "start_us", "left")
    return found.select("start_us", "end_us", "n", "max_rtt_us", "avg_rtt_us", "losses", F.when(F.col("roam"), "roaming").when(F.col("ratio") > 0.3, "high_retry").otherwise("unknown").alias("cause"))


def retry_bursts(frames: DataFrame) -> DataFrame:
    """Three or more retries in a row, and the next control frame after them.

    Rows run in capture order. A burst is named by the last non-retry before
    it; the look ahead is 50 frames from the one that breaks the burst, of
    which the first non-retry control frame counts. No such frame, no row.
    """
    order = ["epoch_us", "source", "number"]
    rows = frames.select(*order, "retry", P.is_control_traffic().alias("ctrl"), P.control_detail().alias("detail")).withColumn("g", F.lit(0))
    ranked = settled(numbered(rows), "ranked")
    runs = carried(ranked, ["g"], order, F.when(~F.col("retry"), F.col("rank")), "after")
    bursts = runs.where("retry").groupBy("after").agg(F.count("*").alias("n"), F.min("epoch_us").alias("start_us"), F.max("epoch_us").alias("end_us"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.min_by("number", "rank").alias("first_num")).where(F.col("n") >= BURST)
    spans = bursts.select(F.lit(0).alias("g"), "n", "start_us", "end_us", "first_num", (F.col("last_rank") + 1).alias("l_start"), (F.col("last_rank") + AHEAD).alias("l_end"))
    ctrl = ranked.where("ctrl and not retry").select(F.lit(0).alias("g"), F.col("rank").alias("r_start"), F.col("rank").alias("r_end"), F.col("number").alias("ctrl_num"), F.col("epoch_us").alias("ctrl_us"), "detail")
    best = overlap_join(spans, ctrl, ["g"], AHEAD).groupBy("n", "start_us", "end_us", "first_num").agg(F.min(F.struct("r_start", "ctrl_num", "ctrl_us", "detail")).alias("c"))
    return best.select("first_num", F.col("n").alias("burst_len"), (F.col("end_us") - F.col("start_us")).alias("burst_us"), (F.col("c.ctrl_us") - F.col("end_us")).alias("delay_us"), F.col("c.ctrl_num").alias("ctrl_num"), F.col("c.detail").alias("detail"))


def rate_fallback(frames: DataFrame) -> DataFrame:
    """Runs of rated retries whose rate index falls from first to last."""
    order = ["epoch_us", "source", "number"]
    rows = frames.select(*order, "retry", "mcs").withColumn("g", F.lit(0))
    hit = F.col("retry") & F.col("mcs").isNotNull()
    ranked = settled(numbered(rows), "ranked")
    runs = carried(ranked, ["g"], order, F.when(~hit, F.col("rank")), "after").where(hit)
    found = runs.groupBy("after").agg(F.count("*").alias("n"), F.min_by("mcs", "rank").alias("first_mcs"), F.max_by("mcs", "rank").alias("last_mcs"), F.min("epoch_us").alias("start_us"), F.min_by("number", "rank").alias("first_num"))
    return found.where("n >= 2 and first_mcs > last_mcs").select("first_num", "start_us", "n", "first_mcs", "last_mcs")
