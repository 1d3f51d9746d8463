"""Evidence, scores, conclusions, incidents and case files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions import thresholds as L
from framewright.functions.tables import settled
from framewright.operators import ping, roaming
from framewright.operators.joins import SECOND, islands, slices
from framewright.operators.stats import one_if, percent

# Windows of incidents, joining pause and overlap; references kept.
BEFORE_US, AFTER_US, JOIN_US, OVERLAP = 10 * SECOND, 10 * SECOND, 3 * SECOND, 0.5
REFS = 100
# Phrases that put a conclusion off.
PUNT = (
    "추가 조사 필요", "추가 조사", "추가 확인 필요", "확인 필요", "조사 필요", "원인 불명", "원인 미상",
    "further investigation needed", "needs further investigation", "further investigation", "needs investigation", "investigate further",
    "to be determined", "unknown cause", "tbd", "todo",
)


def _refs(number: Column, order: Column) -> Column:
    """The first references in time; the sort is bounded by a heap per group."""
    return F.slice(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("t"), number.alias("n")))), lambda x: x["n"]), 1, REFS)


def evidence(frames: DataFrame) -> DataFrame:
    """For weak signal, losses and bursts: references and window.

    Each kind's rows are first cut to the hundred earliest of a station by a
    rank, so the collected lists are bounded.
    """
    weak = frames.where(F.col("rssi") < -75).select(F.col("ta").alias("sta"), F.lit("weak_signal").alias("category"), "epoch_us", "number")
    lost = ping.statuses(frames).where("status = 'loss'").select("sta", F.lit("ping_loss").alias("category"), "epoch_us", F.col("req_num").alias("number"))
    gone = frames.where(F.col("subtype").isin(10, 12)).select(F.col("ta").alias("sta"), F.lit("disconnect").alias("category"), "epoch_us", "number")
    rows = weak.unionByName(lost).unionByName(gone).where(F.col("sta").isNotNull())
    sums = rows.groupBy("sta", "category").agg(F.count("*").alias("n"), F.min("epoch_us").alias("start_us"), F.max("epoch_us").alias("end_us"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("sta", "category").orderBy("epoch_us", "number"))).where(F.col("i") <= REFS)
    refs = first.groupBy("sta", "category").agg(_refs(F.col("number"), F.col("epoch_us")).alias("frame_refs"))
    return sums.join(refs, ["sta", "category"])


def evidence_refs(frames: DataFrame) -> DataFrame:
    """:func:`evidence` with its references as first, last and number."""
    return evidence(frames).select("sta", "category", "n", "start_us", "end_us", F.size("frame_refs").cast("long").alias("refs"), F.element_at("frame_refs", 1).alias("first_ref"))


def health_score(frames: DataFrame) -> DataFrame:
    """Retry, loss and roaming scores and their weighted mean; nulls drop out.

    Without roams nothing is wrong with them; roams that nothing is known of
    count in no score.
    """
    over = frames.agg(percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"))
    loss = ping.totals(frames).select("loss_pct")
    slow = roaming.slow_roams(frames).agg(F.count("*").alias("roams"), one_if(F.col("slow_basis").isNotNull()).alias("decided"), one_if(F.col("is_slow")).alias("slow"))
    one = over.crossJoin(loss).crossJoin(slow)  # one row each
    slow_pct = F.when(F.col("roams") == 0, 0.0).when(F.col("decided") > 0, 100 * F.col("slow") / F.col("decided"))
    fall = lambda x, k: F.when(x.isNotNull(), F.greatest(F.lit(0.0), 100 - k * x))
    parts = [(fall(F.col("retry_pct"), 5), 0.3), (fall(F.col("loss_pct"), 10), 0.4), (fall(slow_pct, 2), 0.3)]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    total = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in parts), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))
    score = F.bround(total, 0).cast("int")
    grade = F.when(score >= 80, "green").when(score >= 60, "yellow").when(score.isNotNull(), "red")
    return one.select(*[F.round(x, 6).alias(n) for (x, _), n in zip(parts, ("retry_score", "loss_score", "roam_score"), strict=True)], score.alias("score"), grade.alias("grade"))


def sta_scores(frames: DataFrame) -> DataFrame:
    """Scores of stations from retries, signal and roaming, and their mean."""
    sta = settled(roaming.stations(frames), "stations")
    ends = frames.select(F.explode(F.array("ta", "ra")).alias("sta"), "retry").groupBy("sta").agg(percent(one_if(F.col("retry")), F.count("*"), 1).alias("r")).join(sta, "sta", "left_semi")
    heard = frames.groupBy(F.col("ta").alias("sta")).agg(F.avg("rssi").alias("s"))
    roams = roaming.slow_roams(frames, sta).groupBy("sta").agg(one_if(F.col("slow_basis").isNotNull()).alias("decided"), one_if(F.col("is_slow")).alias("slow"))
    all_ = ends.join(heard, "sta", "left").join(roams, "sta", "left")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    roam = F.when(F.col("decided").isNull(), 100.0).when(F.col("decided") > 0, F.greatest(F.lit(0.0), 100 - 200 * F.col("slow") / F.col("decided")))
    parts = [(clip(100 - 5 * F.col("r")), 0.35, "retry_score"), (F.when(F.col("s").isNotNull(), clip((F.col("s") + 90) * 2.5)).otherwise(100.0), 0.35, "rssi_score"), (roam, 0.3, "roam_score")]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w, _ in parts), F.lit(0.0))
    total = sum((F.coalesce(x, F.lit(0.0)) * w for x, w, _ in parts), F.lit(0.0)) / weight
    return all_.select("sta", *[F.round(x, 6).alias(n) for x, _, n in parts], F.bround(F.round(total, 9), 0).cast("int").alias("score"))


def conclusions(frames: DataFrame) -> DataFrame:
    """What can be said of each station, each with the frames it rests on.

    Codes: ping_loss, retry_high or retry_some, weak_signal, retry_peak (over
    3000 retries in a minute), many_roams (over 3 authentications), normal;
    and what to do: advise_retry, advise_roaming, advise_ping. ``value`` is the
    measure, ``refs`` how many of the frames (at most a hundred) are listed.
    """
    sta = settled(roaming.stations(frames), "stations")
    own = frames.select(F.explode(F.array_distinct(F.array("ta", "ra"))).alias("sta"), "number", "epoch_us", "retry", "rssi", "subtype", "ta", P.is_request().alias("ask"), F.col("ip_src").alias("src"), F.col("ip_dst").alias("dst"), "icmp_seq").join(sta, "sta", "left_semi")
    told = ping.statuses(frames).where(F.col("status").isNotNull()).groupBy("src", "dst", "icmp_seq").agg(F.max(F.col("status") != "loss").alias("answered"))
    sent = F.col("ask") & ~F.col("retry")
    own = settled(own.join(told, ["src", "dst", "icmp_seq"], "left").select("sta", "number", "epoch_us", "retry", "rssi", F.floor(F.col("epoch_us") / (60 * SECOND)).alias("minute"), ((F.col("subtype") == 11) & (F.col("ta") == F.col("sta"))).alias("auth"), F.coalesce(sent & ~F.col("answered"), F.lit(False)).alias("lost"), F.coalesce(sent & F.col("answered"), F.lit(False)).alias("met")), "conclusions")
    minutes = own.where("retry").groupBy("sta", "minute").agg(F.count("*").alias("k")).groupBy("sta").agg(F.max("k").alias("peak"), F.max_by("minute", F.struct("k", -F.col("minute"))).alias("peak_minute"))
    sums = own.groupBy("sta").agg(F.count("*").alias("n"), one_if(F.col("retry")).alias("retries"), F.min("rssi").alias("low"), one_if(F.coalesce(F.col("auth"), F.lit(False))).alias("auths"), one_if(F.col("lost")).alias("lost"), one_if(F.col("met")).alias("met")).join(minutes, "sta", "left")
    share = 100 * F.col("retries") / F.col("n")
    some = lambda when, value: F.when(when, value.cast("double"))
    weak, loss, auths, peak = F.col("low") < L.RSSI_DBM[1], F.col("lost") > 0, F.col("auths"), F.coalesce("peak", F.lit(0))
    high, warn = share > L.RETRY_PERCENT[1], share.between(L.RETRY_PERCENT[0], L.RETRY_PERCENT[1]) & (share > L.RETRY_PERCENT[0])
    quiet = ~(loss | high | warn | F.coalesce(weak, F.lit(False)) | (peak > 3000) | (auths > 3))
    worse, roams = loss & (share > 2 * L.RETRY_PERCENT[1]), loss & (auths > 2)
    rules = [
        ("ping_loss", "WARNING", some(loss, 100 * F.col("lost") / (F.col("lost") + F.col("met"))), F.col("lost_")),
        ("retry_high", "WARNING", some(high, share), F.col("retry")),
        ("retry_some", "INFO", some(warn, share), F.col("retry")),
        ("weak_signal", "WARNING", some(weak, F.col("low")), F.col("rssi") < L.RSSI_DBM[1]),
        ("retry_peak", "WARNING", some(peak > 3000, peak), F.col("retry") & (F.col("minute") == F.col("peak_minute"))),
        ("many_roams", "INFO", some(auths > 3, auths), F.col("auth")),
        ("normal", "INFO", some(quiet, F.col("n")), F.lit(True)),
        ("advise_retry", "WARNING", some(worse, share), F.col("lost_") | F.col("retry")),
        ("advise_roaming", "WARNING", some(roams, auths), F.col("lost_") | F.col("auth")),
        ("advise_ping", "WARNING", some(loss & ~worse & ~roams, F.col("lost")), F.col("lost_")),
    ]
    said = sums.select("sta", "peak_minute", F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.round(value, 6).alias("value")) for code, level, value, _ in rules])).alias("c")).select("sta", "peak_minute", "c.*").where(F.col("value").isNotNull())
    on = F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(code)) for code, _, _, hit in rules]), lambda c: c.isNotNull())
    rows = own.withColumnRenamed("lost", "lost_").join(sums.select("sta", "peak_minute"), "sta").select("sta", "number", "epoch_us", F.explode(on).alias("code"))
    seen = rows.groupBy("sta", "code").agg(F.count("*").alias("k"), F.min("epoch_us").alias("start_us"), F.max("epoch_us").alias("end_us"), F.min(F.struct("epoch_us", "number")).alias("first"))
    return said.join(seen, ["sta", "code"]).select("sta", "code", "level", "value", F.least(F.col("k"), F.lit(REFS)).cast("long").alias("refs"), F.col("first.number").alias("first_ref"), "start_us", "end_us")


def grounded(found: DataFrame) -> DataFrame:
    """Issues with references and a window, and without empty phrases."""
    return found.where((F.size("frame_refs") > 0) & F.col("start_us").isNotNull() & ~F.lower("message").rlike("|".join(PUNT)))


def _incidents(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of runs of losses; joined to the current one's trigger."""
    out: list[list[int]] = []
    for r in rows.sort_values(["epoch_us", "req_num"]).itertuples(index=False):
        t, a, b = int(r.epoch_us), int(r.epoch_us) - BEFORE_US, int(r.epoch_us) + AFTER_US
        if out:
            cur = out[-1]
            inter, shorter = min(cur[1], b) - max(cur[0], a), min(cur[1] - cur[0], b - a)
            if t - cur[2] <= JOIN_US or (inter >= 0 and inter / shorter >= OVERLAP):
                cur[1] = max(cur[1], b)
                cur[4] += 1
                continue
        out.append([a, b, t, int(r.req_num), 1])
    return pd.DataFrame(out, columns=["start_us", "end_us", "trigger_us", "trigger_num", "losses"])


def incidents(frames: DataFrame) -> DataFrame:
    """Windows around losses, close or overlapping ones joined."""
    lost = ping.statuses(frames).where("status = 'loss'").select(F.lit(0).alias("g"), "epoch_us", "req_num")
    runs = islands(lost, ["g"], ["epoch_us", "req_num"], BEFORE_US + AFTER_US)
    return slices(runs, ["g"]).applyInPandas(_incidents, "start_us long, end_us long, trigger_us long, trigger_num long, losses long")


def casefile(frames: DataFrame) -> DataFrame:
    """The first incident: what was observed in its window.

    One row, its id from the trigger's number and time.
    """
    first = incidents(frames).orderBy("start_us").limit(1)
    inside = frames.join(F.broadcast(first), F.col("epoch_us").between(F.col("start_us"), F.col("end_us")))  # one row
    return inside.groupBy("start_us", "end_us", "trigger_us", "trigger_num", "losses").agg(F.count("*").alias("frames"), percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"), one_if(P.is_roaming()).alias("roaming")).withColumn("case_id", F.format_string("analysis:%d:%d.%03d", "trigger_num", F.floor(F.col("trigger_us") / SECOND), F.floor(F.col("trigger_us") % SECOND / 1000)))
