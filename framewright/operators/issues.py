"""Issues of stations and of the network, each with the frames it rests on.

A rule gives heads (one row an issue) and evidence (the frames behind it). An
issue without a frame or a window is dropped. Of long evidence an even sample
of ``REFS`` frames is kept, with the first and last; places in it come from
slices of time and prefix sums, so no task holds an issue's frames. Issues come
in the order of severity, then of the rules, then of stations.

Nulls: what wasn't measured makes no issue. Ties: the earlier bucket, the
smaller name.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import thresholds as L
from framewright.functions.tables import settled
from framewright.operators import ping, roaming, signals, stats
from framewright.operators.joins import CHUNK_US, SECOND, range_join
from framewright.operators.stats import one_if, percent

# References kept; least frames and share of a hot rate; falls
# and depths; slow and frequent roams; shares and numbers of the network's.
REFS = 100
#: Time of a slice of evidence whose rows may have to be put in order.
THIN_US = 50_000
HOT_FRAMES, HOT_PERCENT, HOT_TIMES, HOT_HIGH = 30, 50, 2, 60
CLIFFS, DEEP_DB, CLIFFS_HIGH, DEEP_HIGH_DB, PAD_US, WIDE_PAD_US = 2, 15, 3, 20, SECOND, 5 * SECOND
SLOW_STATION, FREQUENT, SLOW_NETWORK, LEGACY_PERCENT, ZONES, COVERAGE_PERCENT = 2, 10, 5, 30, 3, 50.0
MODERN = ("HT", "VHT", "HE", "EHT")
# Signals of issues, and the combinations that have a title, the
# first that is met.
SIGNALS = ("weak_rssi", "high_retry", "high_loss", "slow_roaming", "frequent_roaming", "delay_zone", "anomaly", "signal_cliff", "mcs_hotspot", "legacy_heavy")
TITLES = (
    ("signal_cliff", "high_loss"), ("signal_cliff", "high_retry"), ("signal_cliff", "slow_roaming"), ("signal_cliff", "weak_rssi"),
    ("weak_rssi", "mcs_hotspot"), ("high_retry", "mcs_hotspot"),
    ("weak_rssi", "high_retry", "slow_roaming"), ("weak_rssi", "high_retry", "frequent_roaming"),
    ("weak_rssi", "high_retry"), ("weak_rssi", "slow_roaming"), ("high_retry", "slow_roaming"), ("high_retry", "high_loss"), ("weak_rssi", "high_loss"),
)
OVERLAP, LEAST_KINDS, BASE, EACH, BONUS, CAP = 0.5, 2, 0.5, 0.15, 0.1, 0.95

HEAD = ("rule", "scope", "sta", "signal_type", "category", "severity", "value", "n")
ROW = ("rule", "sta", "category", "o", "number", "epoch_us")


def _head(df: DataFrame, rule: int, signal: str | None, category: Column, severity: Column, value: Column, n: Column) -> DataFrame:
    sta = F.col("sta") if "sta" in df.columns else F.lit("")
    scope = F.lit("sta" if "sta" in df.columns else "net")
    return df.select(F.lit(rule).alias("rule"), scope.alias("scope"), sta.alias("sta"), F.lit(signal).cast("string").alias("signal_type"), category.alias("category"), severity.alias("severity"), value.cast("double").alias("value"), n.cast("long").alias("n"))


def _rows(df: DataFrame, rule: int, category: Column, order: Column | None = None) -> DataFrame:
    sta = F.col("sta") if "sta" in df.columns else F.lit("")
    return df.select(F.lit(rule).alias("rule"), sta.alias("sta"), category.alias("category"), (F.col("epoch_us") if order is None else order).cast("long").alias("o"), "number", "epoch_us")


def _worst_bucket(retries: DataFrame, keys: list[str]) -> DataFrame:
    """Retries of the 10 s bucket that has most; of two the one met first."""
    rows = retries.withColumn("bucket", F.floor(F.col("epoch_us") / (10 * SECOND)))
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("k"), F.min("o").alias("first"))
    if keys:
        return rows.join(settled(counts.groupBy(*keys).agg(F.max_by("bucket", F.struct("k", -F.col("first"))).alias("bucket")), "worst-buckets"), [*keys, "bucket"])
    return rows.join(F.broadcast(counts.orderBy(F.desc("k"), "first").limit(1).select("bucket")), "bucket")


def _of_roams(roams: DataFrame) -> DataFrame:
    """Frames of roams: authentication and association, roam by roam."""
    each = F.array(F.struct(F.lit(0).alias("k"), F.col("auth_num").alias("number"), F.col("auth_us").alias("epoch_us")), F.struct(F.lit(1).alias("k"), F.col("assoc_num").alias("number"), F.col("assoc_us").alias("epoch_us")))
    return roams.select("sta", "assoc_us", F.explode(each).alias("x")).select("sta", "x.number", "x.epoch_us", (F.col("assoc_us") * 2 + F.col("x.k")).alias("o")).where(F.col("number").isNotNull())


def _of_stations(frames: DataFrame, sta: DataFrame, roams: DataFrame, drops: DataFrame) -> Iterable[tuple[DataFrame, DataFrame]]:
    """Rules 20 to 24, a station at a time."""
    ends = settled(frames.select(F.explode(F.array(F.struct(F.col("ta").alias("sta"), F.lit(0).alias("side")), F.struct(F.col("ra").alias("sta"), F.lit(1).alias("side")))).alias("e"), "number", "epoch_us", "retry").select("e.*", "number", "epoch_us", "retry").join(sta, "sta", "left_semi"), "ends")
    retry = ends.groupBy("sta").agg(F.round(100 * one_if(F.col("retry")) / F.count("*"), 1).alias("pct"), F.count("*").alias("n"))
    sent = settled(frames.join(sta, F.col("ta") == F.col("sta")).select("sta", "number", "epoch_us", "retry", "rssi", "mcs", "mcs_phy", "data_rate"), "sent")
    none = F.lit("")
    level = F.when(F.col("pct") > L.RETRY_PERCENT[1], "high").when(F.col("pct") > L.RETRY_PERCENT[0], "medium")
    yield (
        _head(retry.withColumn("s", level).where("s is not null"), 20, "high_retry", none, F.col("s"), F.col("pct"), F.col("n")),
        # a station's own frames first, then those it was sent: as they are listed
        _rows(_worst_bucket(ends.where("retry").withColumn("o", F.col("side") * (1 << 60) + F.col("epoch_us")), ["sta"]), 20, none, F.col("side") * 10 * SECOND + F.col("epoch_us") % (10 * SECOND)),
    )
    modern = F.col("mcs_phy").isin(*MODERN)
    rate = F.when(modern, F.concat_ws(" ", "mcs_phy", F.col("mcs").cast("string"))).otherwise(F.concat_ws(" ", F.lit("Legacy"), "data_rate"))
    rated = sent.where(F.when(F.coalesce(modern, F.lit(False)), F.col("mcs").isNotNull()).otherwise(F.col("data_rate").isNotNull())).withColumn("rate", rate)
    by_rate = rated.groupBy("sta", "rate").agg(F.count("*").alias("total"), F.round(100 * one_if(F.col("retry")) / F.count("*"), 1).alias("pct")).join(retry.select("sta", F.col("pct").alias("own")), "sta")
    hot = by_rate.where((F.col("total") >= HOT_FRAMES) & (F.col("pct") >= F.greatest(F.lit(float(HOT_PERCENT)), HOT_TIMES * F.col("own"))))
    hot = hot.groupBy("sta").agg(F.min(F.struct(-F.col("pct"), "rate", "total")).alias("b")).select("sta", F.col("b.rate").alias("rate"), (-F.col("b.col1")).alias("pct"), F.col("b.total").alias("n"))
    hot = settled(hot, "hot-rates")
    yield _head(hot, 21, "mcs_hotspot", none, F.when(F.col("pct") >= HOT_HIGH, "high").otherwise("medium"), F.col("pct"), F.col("n")), _rows(rated.where("retry").join(hot.select("sta", "rate"), ["sta", "rate"]), 21, none)

    falls = drops.join(sta, "sta", "left_semi")
    deep = falls.groupBy("sta").agg(F.count("*").alias("n"), F.max(F.col("before") - F.col("after")).alias("db")).where((F.col("n") >= CLIFFS) | (F.col("db") >= DEEP_DB))
    severe = (F.col("n") >= CLIFFS_HIGH) | (F.col("db") >= DEEP_HIGH_DB)
    points = falls.join(deep.select("sta"), "sta", "left_semi").select("sta", (F.col("sec") * SECOND).alias("t"))
    at = sent.select("sta", F.col("epoch_us").alias("at_us"), "number", "rssi")
    near = range_join(points, at, ["sta"], "at_us", -PAD_US, PAD_US).select("sta", "number", F.col("at_us").alias("epoch_us")).distinct()
    # without any: the weakest frames about the deepest fall
    worst = falls.join(deep.select("sta"), "sta", "left_semi").groupBy("sta").agg(F.max_by("sec", F.struct(F.col("before") - F.col("after"), -F.col("sec"))).alias("sec")).join(near.select("sta"), "sta", "left_anti").select("sta", (F.col("sec") * SECOND).alias("t"))
    wide = range_join(worst, at.where("rssi is not null"), ["sta"], "at_us", -WIDE_PAD_US, WIDE_PAD_US)
    weakest = wide.join(wide.groupBy("sta").agg(F.min("rssi").alias("rssi")), ["sta", "rssi"]).select("sta", "number", F.col("at_us").alias("epoch_us"))
    yield _head(deep, 22, "signal_cliff", none, F.when(severe, "high").otherwise("medium"), F.col("db"), F.col("n")), _rows(near.unionByName(weakest), 22, none)

    heard = sent.where("rssi is not null")
    mean = heard.groupBy("sta").agg(F.round(F.avg("rssi"), 1).alias("avg"), F.min("rssi").alias("low"), F.count("*").alias("n"))
    weak = settled(mean.withColumn("limit", F.when(F.col("avg") < L.RSSI_DBM[1], L.RSSI_DBM[1]).when(F.col("avg") < L.RSSI_DBM[0], L.RSSI_DBM[0])).where("limit is not null"), "weak-stations")
    yield _head(weak, 23, "weak_rssi", none, F.when(F.col("limit") == L.RSSI_DBM[1], "high").otherwise("medium"), F.col("avg"), F.col("n")), _rows(heard.join(weak.select("sta", "limit", "low"), "sta").where(F.when(F.col("low") < F.col("limit"), F.col("rssi") < F.col("limit")).otherwise(F.col("rssi") == F.col("low"))), 23, none)

    many = roams.groupBy("sta").agg(F.count("*").alias("n"), one_if(F.col("is_slow")).alias("slow")).withColumn("kind", F.when(F.col("slow") > SLOW_STATION, "slow_roaming").when(F.col("n") > FREQUENT, "frequent_roaming")).where("kind is not null")
    head = _head(many, 24, None, none, F.when(F.col("kind") == "slow_roaming", "high").otherwise("medium"), F.when(F.col("kind") == "slow_roaming", F.col("slow")).otherwise(F.col("n")), F.col("n"))
    kinds = many.select("sta", "kind")
    shown = roams.join(kinds, "sta").where((F.col("kind") != "slow_roaming") | F.col("is_slow")).drop("kind")
    yield head.drop("signal_type").join(kinds.withColumnRenamed("kind", "signal_type"), "sta").select(*HEAD), _rows(_of_roams(shown), 24, none, F.col("o"))


def _of_network(frames: DataFrame, roams: DataFrame, lost: DataFrame, zones: DataFrame, loss: DataFrame, coverage: DataFrame | None) -> Iterable[tuple[DataFrame, DataFrame]]:
    """Rules 1 to 7, of the network as a whole."""
    high, none = F.lit("high"), F.lit("")
    over = frames.agg(percent(one_if(F.col("retry")), F.count("*")).alias("pct"), F.count("*").alias("n")).where(F.col("pct") > L.RETRY_PERCENT[1])
    yield _head(over, 1, "high_retry", F.lit("Retry"), high, F.col("pct"), F.col("n")), _rows(_worst_bucket(frames.where("retry").withColumn("o", F.col("epoch_us")), []), 1, F.lit("Retry"))
    legacy = stats.legacy_share(frames).where(F.col("legacy_pct") >= LEGACY_PERCENT)
    plain = frames.where(F.col("ta").isNotNull() & ~F.coalesce(F.col("mcs_phy").isin(*MODERN), F.lit(False)))
    yield _head(legacy, 2, "legacy_heavy", F.lit("PHY"), F.lit("medium"), F.col("legacy_pct"), F.col("buckets")), _rows(plain, 2, F.lit("PHY"))
    bad = loss.where(F.col("loss_pct") > L.LOSS_PERCENT[1])
    yield _head(bad, 3, "high_loss", F.lit("Ping"), high, F.col("loss_pct"), F.lit(None)), _rows(lost, 3, F.lit("Ping"))
    slow = roams.where("is_slow")
    yield _head(slow.agg(F.count("*").alias("n")).where(F.col("n") > SLOW_NETWORK), 4, "slow_roaming", F.lit("Roaming"), high, F.col("n"), F.col("n")), _rows(_of_roams(slow).drop("sta"), 4, F.lit("Roaming"), F.col("o"))
    if coverage is not None:  # a limit of the measurement, no signal of trouble
        low = coverage.where(F.col("reportable") & (F.col("visible_pct") < COVERAGE_PERCENT))
        yield _head(low, 5, None, F.lit("Coverage"), F.lit("medium"), F.col("visible_pct"), F.col("n")), _rows(_of_roams(roams.where("sta_total_ms is not null")).drop("sta"), 5, F.lit("Coverage"), F.col("o"))
    odd = stats.anomalies(frames).where("level is not null")
    kind = F.when(F.col("subtype").isin(10, 12), "deauth").when(F.col("subtype") == 4, "probe").when((F.col("protocol") == "ARP") | F.col("arp_opcode").isNotNull(), "arp")
    yield _head(odd, 6, "anomaly", F.col("kind"), F.col("level"), F.col("share"), F.col("n")), _rows(frames.withColumn("kind", kind).where("kind is not null"), 6, F.col("kind"))
    many = zones.agg(F.count("*").alias("n")).where(F.col("n") > ZONES)
    rest = _of_roams(roams).drop("sta").join(F.broadcast(lost.limit(1).select(F.lit(1).alias("any"))), F.lit(True), "left_anti")  # where no loss is known
    yield _head(many, 7, "delay_zone", F.lit("Delay"), F.lit("medium"), F.col("n"), F.col("n")), _rows(lost.withColumn("o", F.col("epoch_us")).unionByName(rest), 7, F.lit("Delay"), F.col("o"))


def _sampled(rows: DataFrame) -> DataFrame:
    """References and window of each issue's evidence.

    Numbers of thin slices tell which of them hold a place of the sample; only
    these slices' rows are put in order.
    """
    keys = ["rule", "sta", "category"]
    cut = rows.withColumn("slice", F.floor(F.col("o") / THIN_US))
    sizes = cut.groupBy(*keys, "slice").agg(F.count("*").alias("k"), F.min("epoch_us").alias("a"), F.max("epoch_us").alias("b"))
    sizes = settled(sizes.withColumn("chunk", F.floor(F.col("slice") * THIN_US / CHUNK_US)), "slices")
    line = Window.partitionBy(*keys)
    chunks = sizes.groupBy(*keys, "chunk").agg(F.sum("k").alias("in_chunk"))
    chunks = chunks.select(*keys, "chunk", (F.sum("in_chunk").over(line.orderBy("chunk")) - F.col("in_chunk")).alias("earlier"), F.sum("in_chunk").over(line).alias("all"))
    within = F.sum("k").over(Window.partitionBy(*keys, "chunk").orderBy("slice")) - F.col("k")
    placed = sizes.withColumn("within", within).join(chunks, [*keys, "chunk"]).withColumn("before", F.col("earlier") + F.col("within"))
    end, i = F.col("before") + F.col("k"), F.ceil(F.col("before") * REFS / F.col("all"))
    inside = [F.floor((i + d) * F.col("all") / REFS).between(F.col("before"), end - 1) & (i + d < REFS - 1) for d in (-1, 0, 1)]
    wanted = (F.col("all") <= REFS) | (end == F.col("all")) | inside[0] | inside[1] | inside[2]
    before = settled(placed.where(wanted).select(*keys, "slice", "before", "all"), "sampled-slices")
    ranked = cut.join(before, [*keys, "slice"])
    place = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("o", "number")) - 1
    ranked = ranked.withColumn("r", place + F.col("before"))
    i = F.ceil(F.col("r") * REFS / F.col("all"))
    even = (i < REFS - 1) & (F.floor(i * F.col("all") / REFS) == F.col("r"))
    kept = ranked.where((F.col("all") <= REFS) | even | (F.col("r") == F.col("all") - 1))
    refs = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "number"))), lambda x: x["number"]).alias("frame_refs"))
    return refs.join(sizes.groupBy(*keys).agg(F.min("a").alias("start_us"), F.max("b").alias("end_us")), keys)


def issues(frames: DataFrame, totals: DataFrame | None = None, loss: DataFrame | None = None) -> DataFrame:
    """All issues: place, scope, sta, signal_type, category, severity, value, n,
    frame_refs, start_us, end_us.

    ``totals`` (assoc_num, sta_total_ms) are what logs tell of roams, ``loss``
    one row with the loss_pct to judge by; without them the capture decides.
    """
    sta = settled(roaming.stations(frames), "stations")
    found = roaming.four_way(frames, sta)
    told = totals.select("assoc_num", "sta_total_ms") if totals is not None else frames.sparkSession.createDataFrame([], "assoc_num long, sta_total_ms double")
    found = found.join(told, "assoc_num", "left")
    slow, _ = roaming.slow_by(F.col("sta_total_ms"), F.col("total_us") / 1000, F.col("gap_us") / 1000)
    roams = settled(found.withColumn("is_slow", slow), "judged-roams")
    seen = None if totals is None else roaming.coverage(roams.select("sta_total_ms", (F.col("total_us") / 1000).alias("capture_total_ms")))
    drops = settled(signals.cliffs(frames).withColumnRenamed("ta", "sta"), "falls")
    lost = settled(ping.statuses(frames).where("status = 'loss'").select("epoch_us", F.col("req_num").alias("number")), "losses")
    zones = settled(signals.delay_zones(frames), "zones")
    parts = [*_of_network(frames, roams, lost, zones, ping.totals(frames) if loss is None else loss, seen), *_of_stations(frames, sta, roams, drops)]
    heads = settled(reduce(DataFrame.unionByName, [h.select(*HEAD) for h, _ in parts]), "issue-heads")
    rows = reduce(DataFrame.unionByName, [r.select(*ROW) for _, r in parts]).join(F.broadcast(heads.select("rule", "sta", "category")), ["rule", "sta", "category"], "left_semi")  # a few issues a station
    found = heads.join(_sampled(rows), ["rule", "sta", "category"])
    falls = drops.groupBy("sta").agg(F.min("sec").alias("fa"), F.max("sec").alias("fb")).withColumn("rule", F.lit(22))
    delays = zones.agg(F.min("start_us").alias("za"), F.max("end_us").alias("zb")).withColumn("rule", F.lit(7)).join(F.broadcast(lost.limit(1).select(F.lit(7).alias("rule"))), "rule", "left_semi")
    found = found.join(falls, ["sta", "rule"], "left").join(F.broadcast(delays), "rule", "left")
    found = found.withColumn("start_us", F.coalesce(F.col("fa") * SECOND, "za", "start_us")).withColumn("end_us", F.coalesce(F.col("fb") * SECOND, "zb", "end_us"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    order = Window.orderBy(rank, F.when(F.col("scope") == "net", F.col("rule")).otherwise(20), "sta", "rule", "category")  # issues are few: some a station
    return found.select(F.row_number().over(order).cast("long").alias("place"), "rule", "scope", F.nullif("sta", F.lit("")).alias("sta"), "signal_type", "category", "severity", "value", "n", "frame_refs", "start_us", "end_us")


def _ratio(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Shared part of two windows by the shorter; a point inside counts whole."""
    if a[1] < a[0] or b[1] < b[0]:
        return 0.0
    least = min(a[1] - a[0], b[1] - b[0])
    shared = min(a[1], b[1]) - max(a[0], b[0])
    return (1.0 if shared >= 0 else 0.0) if least == 0 else max(0, shared) / least


CORRELATED = "sta string, title string, kinds string, confidence double, start_us long, end_us long, signals long, refs long, frame_refs array<bigint>"


def _correlated(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups of one station's issues, in the rules' order."""
    groups: list[list[tuple]] = []
    for r in rows.sort_values("rule").itertuples(index=False):
        own = (r.signal_type, (r.start_us, r.end_us), list(r.frame_refs))
        home = next((g for g in groups if all(_ratio(own[1], m[1]) >= OVERLAP for m in g)), None)
        if home is None:
            groups.append([own])
        else:
            home.append(own)
    for x in rows["net"].iloc[0]:
        own = (x["signal_type"], (x["start_us"], x["end_us"]), list(x["frame_refs"]))
        for g in groups:
            if any(_ratio(own[1], m[1]) >= OVERLAP for m in g):
                g.append(own)
    out = []
    for g in groups:
        kinds = dict.fromkeys(k for k, _, _ in g)
        if len(kinds) < LEAST_KINDS:
            continue
        pairs = [_ratio(a[1], b[1]) for i, a in enumerate(g) for b in g[i + 1 :]]
        score = round(min(CAP, BASE + EACH * (len(kinds) - 1) + BONUS * (sum(pairs) / len(pairs))), 3)
        title = next(("+".join(t) for t in TITLES if set(t) <= set(kinds)), "several")
        refs = list(dict.fromkeys(n for _, _, own in g for n in own))
        out.append((rows["sta"].iloc[0], title, "+".join(sorted(kinds)), score, min(w[0] for _, w, _ in g), max(w[1] for _, w, _ in g), len(g), len(refs), refs))
    return pd.DataFrame(out, columns=[c.split()[0] for c in CORRELATED.split(", ")])


def causality(found: DataFrame) -> DataFrame:
    """Issues of a station that coincide, with the network's that touch them.

    A group takes a further issue that overlaps all of it by half, in the order
    of the rules; the network's signals then join wherever they overlap one by
    half. Two kinds at least make a finding; its title is the first combination
    of :data:`TITLES` among its kinds.
    """
    told = settled(found.where("signal_type is not null"), "signals")
    net = F.array_sort(F.collect_list(F.struct("place", "signal_type", "start_us", "end_us", "frame_refs")))
    nets = told.where("scope = 'net'").agg(net.alias("net"))  # at most nine rows
    own = told.where("scope = 'sta'").select("sta", "rule", "signal_type", "start_us", "end_us", "frame_refs")
    return own.crossJoin(F.broadcast(nets)).groupBy("sta").applyInPandas(_correlated, CORRELATED)
