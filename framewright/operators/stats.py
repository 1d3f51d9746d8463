"""Counts and distributions: seconds, devices, rates, roles, channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import channels as C
from framewright.functions import frames as P
from framewright.functions import thresholds as L
from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, numbered

#: Longest span, in seconds, that is filled with empty seconds.
FILL_CAP = 21_600
LEAST_FRAMES, TOP = 5, 20
#: Share of retries at the highest rates from which they lean there.
TOP_MCS_PERCENT = 60
BINS = 60


def second(t: Column | None = None) -> Column:
    """Whole second of a time in microseconds."""
    return F.floor((F.col("epoch_us") if t is None else t) / SECOND).cast("long")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded share; null where the whole is zero."""
    return F.when(whole > 0, F.round(100 * part / whole, digits))


def one_if(c: Column) -> Column:
    """How many rows meet a condition."""
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def per_second(frames: DataFrame, cap: int = FILL_CAP) -> DataFrame:
    """Frames, retries and bytes of each second; zero-filled up to the cap."""
    sums = frames.groupBy(second().alias("sec")).agg(
        F.count("*").alias("total"),
        one_if(F.col("retry")).alias("retry"),
        F.sum("length").cast("long").alias("bytes"),
        F.sum(F.when(F.col("subtype").isin(*P.DATA), F.col("length")).otherwise(0)).cast("long").alias("data_bytes"),
    )
    span = frames.agg(F.min(second()).alias("a"), F.max(second()).alias("b")).where(F.col("b") - F.col("a") <= cap)
    every = span.select(F.explode(F.sequence("a", "b")).alias("sec"))
    seconds = every.unionByName(sums.select("sec")).distinct()
    return seconds.join(sums, "sec", "left").na.fill(0)


def per_minute(frames: DataFrame) -> DataFrame:
    """Totals, retries and control traffic of each minute, and hotspots."""
    ctrl = P.is_control_traffic()
    found = frames.groupBy(F.floor(F.col("epoch_us") / (60 * SECOND)).cast("long").alias("minute")).agg(
        F.count("*").alias("total"), one_if(F.col("retry")).alias("retry"), one_if(ctrl).alias("ctrl"), one_if(ctrl & F.col("retry")).alias("ctrl_retry")
    )
    return found.withColumn("hotspot", F.col("retry") > 1000)


def overview_kinds(frames: DataFrame) -> DataFrame:
    """Frames by type and subtype, with retry share."""
    return frames.groupBy(P.frame_type(F.col("subtype")).alias("kind"), P.subtype_name(F.col("subtype")).alias("subtype")).agg(
        F.count("*").alias("n"), percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct")
    )


def protocol_topk(frames: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent protocols; ties go to the one seen first."""
    seen = frames.groupBy("protocol").agg(F.count("*").alias("n"), F.min(F.struct("epoch_us", "number")).alias("first"))
    return seen.orderBy(F.desc("n"), "first").limit(k).select("protocol", "n")


def overview(frames: DataFrame) -> DataFrame:
    """One row: frames, retry share, duration, devices, channels.

    The duration is from the first frame listed to the last.
    """
    return frames.agg(
        F.count("*").alias("frames"),
        percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"),
        ((F.max_by("epoch_us", "number") - F.min_by("epoch_us", "number")) / SECOND).alias("duration_sec"),
        F.count_distinct("ta").alias("senders"),
        F.count_distinct("channel_freq").alias("channels"),
    )


def roles(frames: DataFrame) -> DataFrame:
    """APs and stations with names numbered by frames: mac, role, name, count.

    APs send beacons, probe or association responses. Stations are unicast
    peers of data frames of known APs that send or receive at least five
    frames of any kind.
    """
    end = lambda c, sent: F.struct(F.col(c).alias("mac"), F.lit(sent).alias("sent"))
    data = F.col("subtype").isin(*P.DATA)
    ends = frames.select(F.explode(F.array(end("ta", True), end("ra", False))).alias("e"), F.coalesce(data, F.lit(False)).alias("data"), F.when(data, F.col("bssid")).alias("bssid"), F.col("subtype").isin(1, 3, 5, 8).alias("ap"))
    # One pass over the frames; what is left has a row a device and AP.
    sums = settled(ends.where("e.mac is not null").groupBy(F.col("e.mac").alias("mac"), "data", "bssid").agg(F.count("*").alias("n"), F.max(F.col("ap") & F.col("e.sent")).alias("ap")), "ends")
    ap = sums.where(F.col("ap") & P.is_unicast(F.col("mac"))).select("mac").distinct()
    counts = sums.groupBy("mac").agg(F.sum("n").alias("count"))
    peers = sums.where("data").select("mac", "bssid")
    known = peers.join(ap.select(F.col("mac").alias("bssid")), "bssid", "left_semi").select("mac")
    some_ap = ap.limit(1).select(F.lit(True).alias("some"))
    loose = peers.join(some_ap, F.lit(True), "left_anti").select("mac")  # without any AP the filter is skipped
    sta = known.unionByName(loose).where(P.is_unicast(F.col("mac"))).join(ap, "mac", "left_anti").distinct()
    every = ap.select("mac", F.lit("AP").alias("role")).unionByName(sta.select("mac", F.lit("STA").alias("role"))).join(counts, "mac").where((F.col("role") == "AP") | (F.col("count") >= LEAST_FRAMES))
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("count"), "mac"))
    tail = F.right(F.regexp_replace("mac", ":", ""), F.lit(6))
    return every.select("mac", "role", F.concat("role", rank.cast("string"), F.lit("("), tail, F.lit(")")).alias("name"), "count")


def device_ips(frames: DataFrame) -> DataFrame:
    """Addresses of devices by weight: sender 2, receiver 1; up to five."""
    sent = frames.select(F.col("ta").alias("mac"), F.col("ip_src").alias("ip"), F.lit(2).alias("w"))
    got = frames.select(F.col("ra").alias("mac"), F.col("ip_dst").alias("ip"), F.lit(1).alias("w"))
    weights = sent.unionByName(got).where(~P.is_special_ip(F.col("ip")) & P.is_unicast(F.col("mac"))).groupBy("mac", "ip").agg(F.sum("w").alias("weight"))
    top = F.max("weight").over(Window.partitionBy("mac"))
    rank = F.row_number().over(Window.partitionBy("mac").orderBy(F.desc("weight"), "ip"))
    return weights.withColumn("top", top).where(F.col("weight") >= F.greatest(F.lit(2), 0.05 * F.col("top"))).withColumn("rank", rank).where("rank <= 5").select("mac", "ip", "weight", "rank")


def channel_map(frames: DataFrame) -> DataFrame:
    """The commonest beacon frequency of each AP, its channel and band."""
    seen = frames.where((F.col("subtype") == 8) & F.col("channel_freq").isNotNull()).groupBy(F.col("ta").alias("ap"), "channel_freq").agg(F.count("*").alias("n"), F.min(F.struct("epoch_us", "number")).alias("first"))
    best = seen.groupBy("ap").agg(F.max_by("channel_freq", F.struct("n", -F.col("first.epoch_us"), -F.col("first.number"))).alias("channel_freq"))
    return best.select("ap", "channel_freq", C.channel(F.col("channel_freq")).alias("channel"), C.band(F.col("channel_freq")).alias("band"))


def channel_distribution(frames: DataFrame) -> DataFrame:
    """Frames by frequency."""
    known = frames.where(F.col("channel_freq").isNotNull())
    return known.groupBy("channel_freq").agg(F.count("*").alias("n")).select("channel_freq", C.channel(F.col("channel_freq")).alias("channel"), C.band(F.col("channel_freq")).alias("band"), "n")


def throughput(frames: DataFrame) -> DataFrame:
    """Average and peak megabits a second of all frames."""
    s = per_second(frames, 0).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("peak"), F.min("sec").alias("a"), F.max("sec").alias("b"))
    mbps = lambda x: F.round(x * 8 / 1e6, 6)
    return s.select(mbps(F.col("bytes") / (F.col("b") - F.col("a") + 1)).alias("avg_mbps"), mbps(F.col("peak")).alias("peak_mbps"))


def retry_by_mcs(frames: DataFrame) -> DataFrame:
    """Frames and retries of each rate index."""
    return frames.where(F.col("mcs").isNotNull()).groupBy("mcs").agg(F.count("*").alias("total"), one_if(F.col("retry")).alias("retry"), percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"))


def top_mcs_share(frames: DataFrame) -> DataFrame:
    """Retries at rate indices 14 and 15 among all rated retries, and whether
    they lean to these (over 60 %); null without such frames or retries."""
    top, retry = F.col("mcs").isin(14, 15), F.col("retry")
    sums = frames.where(F.col("mcs").isNotNull()).agg(one_if(retry).alias("retries"), one_if(top & retry).alias("top_retries"), one_if(top).alias("top_frames"))
    share = F.when(F.col("top_frames") > 0, 100 * F.col("top_retries") / F.nullif("retries", F.lit(0)))
    return sums.select("retries", "top_retries", "top_frames", F.round(share, 2).alias("top_pct"), (share > TOP_MCS_PERCENT).alias("leaning"))


def legacy_share(frames: DataFrame) -> DataFrame:
    """Share of legacy frames among sent ones, from 10 s buckets, and whether
    it is an issue (30 % or more)."""
    b = frames.where(F.col("ta").isNotNull()).groupBy(F.floor(F.col("epoch_us") / (10 * SECOND)).alias("bucket")).agg(F.count("*").alias("tx"), percent(one_if(F.col("mcs_phy") == "Legacy"), F.count("*"), 1).alias("pct"))
    share = F.round(F.sum(F.col("pct") * F.col("tx")) / F.nullif(F.sum("tx"), F.lit(0)), 1)
    return b.agg(F.count("*").alias("buckets"), F.coalesce(share, F.lit(0.0)).alias("legacy_pct")).withColumn("issue", F.col("legacy_pct") >= 30)


def categories(frames: DataFrame) -> DataFrame:
    """Frames by category of their subtype and of their protocol."""
    return frames.groupBy(P.frame_category(F.col("subtype")).alias("frame_category"), P.protocol_category(F.col("protocol")).alias("protocol_category")).agg(F.count("*").alias("n"))


def frame_rows(frames: DataFrame) -> DataFrame:
    """Frames as lines of a table: what a reader looks up by number."""
    stamp = F.date_format(F.timestamp_micros("epoch_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return frames.select("number", stamp.alias("timestamp"), P.time_short(stamp).alias("time"), F.concat_ws("/", P.frame_type(F.col("subtype")), P.subtype_name(F.col("subtype"))).alias("type_subtype"), "retry", "mcs", "rssi", "reason_code", "seq", "source")


def retry_per_sec(frames: DataFrame) -> DataFrame:
    """Retry share of each sender and second."""
    return frames.where(F.col("ta").isNotNull()).groupBy("ta", second().alias("sec")).agg(F.count("*").alias("total"), percent(one_if(F.col("retry")), F.count("*"), 1).alias("retry_pct"))


def rssi_buckets(frames: DataFrame) -> DataFrame:
    """Signal of each sender and second, and its commonest rate index."""
    heard = frames.where(F.col("rssi").isNotNull() & F.col("ta").isNotNull()).withColumn("sec", second())
    level = heard.groupBy("ta", "sec").agg(F.round(F.avg("rssi"), 6).alias("avg_rssi"), F.min("rssi").alias("min_rssi"), F.max("rssi").alias("max_rssi"), F.count("*").alias("n"))
    rate = heard.where(F.col("mcs").isNotNull()).groupBy("ta", "sec", "mcs").count()
    best = rate.groupBy("ta", "sec").agg(F.max_by("mcs", F.struct("count", -F.col("mcs"))).alias("mode_mcs"))
    return level.join(best, ["ta", "sec"], "left")


def device_stats(frames: DataFrame) -> DataFrame:
    """Totals of each device, as sender or receiver, in 10 s buckets.

    A frame sent to oneself counts twice.
    """
    ends = frames.select("*", F.explode(F.array("ta", "ra")).alias("device")).where(F.col("device").isNotNull())
    return ends.groupBy("device", F.floor(F.col("epoch_us") / (10 * SECOND)).cast("long").alias("bucket")).agg(
        F.count("*").alias("total"),
        one_if(F.col("retry")).alias("retry"),
        percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"),
        percent(one_if(F.col("mcs_phy") == "Legacy"), F.count("mcs_phy")).alias("legacy_pct"),
        F.round(F.avg("rssi"), 6).alias("avg_rssi"),
    )


def system_peaks(frames: DataFrame, k: int = 3) -> DataFrame:
    """The k 10 s buckets of the highest retry share (over 50 frames, 10 %)."""
    b = frames.groupBy(F.floor(F.col("epoch_us") / (10 * SECOND)).cast("long").alias("bucket")).agg(F.count("*").alias("total"), one_if(F.col("retry")).alias("retry"))
    b = b.withColumn("retry_pct", percent(F.col("retry"), F.col("total")))
    return b.where("total > 50 and retry_pct >= 10").orderBy(F.desc("retry_pct"), "bucket").limit(k)


def phy_mcs_grouping_sets(frames: DataFrame) -> DataFrame:
    """Frames and retries by format, rate index, streams and their subtotals."""
    rated = frames.where(F.col("mcs_phy").isNotNull()).select("mcs_phy", F.coalesce("mcs", F.lit(-1)).alias("mcs"), F.coalesce("nss", F.lit(-1)).alias("nss"), "retry")
    sums = rated.groupingSets([["mcs_phy"], ["mcs_phy", "mcs"], ["mcs_phy", "mcs", "nss"]], "mcs_phy", "mcs", "nss")
    return sums.agg(F.count("*").alias("total"), one_if(F.col("retry")).alias("retry"), F.grouping_id().cast("long").alias("level"))


def ap_compare(frames: DataFrame) -> DataFrame:
    """Totals of APs side by side, frame types as columns."""
    kinds = ["Management", "Control", "Data", "Other"]
    at = frames.where(F.col("bssid").isNotNull() & (F.col("bssid") != P.BROADCAST)).withColumn("kind", P.frame_type(F.col("subtype")))
    wide = at.groupBy("bssid").pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)
    wide = wide.select("bssid", *[F.col(k).alias(k.lower()) for k in kinds])
    sums = at.groupBy("bssid").agg(
        F.count("*").alias("total"),
        percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"),
        F.round(F.avg(F.when(F.col("subtype") == 8, F.col("rssi"))), 6).alias("beacon_rssi"),
        one_if(F.col("subtype").isin(0, 2)).alias("roam_in"),
    )
    return sums.join(wide, "bssid")


def signal_quality(frames: DataFrame) -> DataFrame:
    """Signal of each sender, and the frame it was worst at."""
    heard = frames.where(F.col("rssi").isNotNull() & F.col("ta").isNotNull())
    return heard.groupBy("ta").agg(F.count("*").alias("n"), F.min("rssi").alias("min_rssi"), F.max("rssi").alias("max_rssi"), F.round(F.avg("rssi"), 6).alias("avg_rssi"), F.min_by("number", F.struct("rssi", "epoch_us", "number")).alias("worst_frame"))


def anomalies(frames: DataFrame) -> DataFrame:
    """Deauthentication, probe and ARP levels: kind, n, share, level (null: no
    anomaly).

    Disconnections are an anomaly from the first; probe requests and frames of
    the protocol ARP by their share. Subtypes and protocols count where they
    are among the ``TOP`` commonest.
    """
    seen = lambda c, kinds: frames.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(F.struct("epoch_us", "number")).alias("first")).orderBy(F.desc("n"), "first").limit(TOP).join(kinds, "value")
    spark = frames.sparkSession
    subtypes = seen("subtype", spark.createDataFrame([("10", "deauth"), ("12", "deauth"), ("4", "probe")], "value string, kind string"))
    protocols = seen("protocol", spark.createDataFrame([("ARP", "arp")], "value string, kind string"))
    every = spark.createDataFrame([("deauth",), ("probe",), ("arp",)], "kind string")
    counts = every.join(subtypes.unionByName(protocols).groupBy("kind").agg(F.sum("n").alias("n")), "kind", "left").na.fill(0, ["n"])
    total = frames.agg(F.count("*").alias("total"))
    share = 100 * F.col("n") / F.col("total")
    steps = lambda x, a, b, c: F.when(x > c, "high").when(x > b, "medium").when(x > a, "low")
    level = F.when(F.col("kind") == "deauth", steps(F.col("n"), 0, 3, 10)).when(F.col("kind") == "probe", steps(share, 5, 10, 20)).otherwise(steps(share, 2, 5, 10))
    return counts.crossJoin(F.broadcast(total)).where("total > 0").select("kind", "n", F.round(share, 6).alias("share"), level.alias("level"))  # one row


def severity_levels(frames: DataFrame) -> DataFrame:
    """Severity of each sender's retry share, signal and rate."""
    s = frames.where(F.col("ta").isNotNull()).groupBy("ta").agg((100 * one_if(F.col("retry")) / F.count("*")).alias("r"), F.avg("rssi").alias("s"), F.avg("mcs").alias("m"))
    return s.select("ta", L.above(F.col("r"), L.RETRY_PERCENT).alias("retry_level"), L.below(F.col("s"), L.RSSI_DBM).alias("rssi_level"), L.below(F.col("m"), L.MCS).alias("mcs_level"))


def time_axis(frames: DataFrame) -> DataFrame:
    """One row: the span of time that all series share."""
    return frames.agg(F.min("epoch_us").alias("a"), F.max("epoch_us").alias("b"))


def in_bins(rows: DataFrame, axis: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows with their ``bin`` of the axis; a span of one point is one bin."""
    place = F.floor((F.col("epoch_us") - F.col("a")) * bins / F.greatest(F.col("b") - F.col("a"), F.lit(1)))
    placed = rows.crossJoin(F.broadcast(axis))  # one row
    return placed.withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("long")).drop("a", "b")


def time_axis_bins(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """Frames, retry share and signal over equal bins of the whole span."""
    placed = in_bins(frames.select("epoch_us", "retry", "rssi"), time_axis(frames), bins)
    return placed.groupBy("bin").agg(F.count("*").alias("total"), F.sum(P.retry_units(F.col("retry"))).alias("retries"), percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"), F.round(F.avg("rssi"), 6).alias("avg_rssi"), F.min("rssi").alias("min_rssi"), F.max("rssi").alias("max_rssi"))


def ping_bins(found: DataFrame, axis: DataFrame, bins: int = BINS) -> DataFrame:
    """Answered and lost pings (epoch_us, status) over the same bins."""
    known = found.where(F.col("status").isin("matched", "late", "loss", "loss_gap")).select("epoch_us", F.col("status").isin("loss", "loss_gap").alias("lost"))
    return in_bins(known, axis, bins).groupBy("bin").agg(one_if(~F.col("lost")).alias("success"), one_if(F.col("lost")).alias("loss"), F.count("*").alias("total"), percent(one_if(F.col("lost")), F.count("*"), 1).alias("loss_pct"))


def downsample_peak(frames: DataFrame, stride: int = 60) -> DataFrame:
    """Of each stride of seconds, the second with the most retries."""
    s = per_second(frames, 0)
    return s.groupBy(F.floor(F.col("sec") / stride).cast("long").alias("stride")).agg(F.max_by("sec", F.struct("retry", -F.col("sec"))).alias("sec"), F.max("retry").alias("retry"))


def control_list(frames: DataFrame) -> DataFrame:
    """Control traffic frame by frame, with what it is."""
    return frames.where(P.is_control_traffic()).select("number", "epoch_us", "ta", "ra", P.control_detail().alias("detail"), "retry")


def uniform_sample(frames: DataFrame, k: int = 100) -> DataFrame:
    """k frame numbers evenly spread over capture order, first and last too.

    The order is that of :func:`framewright.operators.joins.numbered`.
    """
    order = numbered(frames.select("number", "epoch_us", "source")).select("number", F.col("rank").alias("n"))
    total = frames.agg(F.count("*").alias("total"))
    at = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    wanted = total.where("total > 0").select("total", at.alias("i")).select(F.when(F.col("i") == k - 1, F.col("total")).otherwise(F.floor(F.col("i") * F.col("total") / k) + 1).cast("int").alias("n")).distinct()
    return order.join(F.broadcast(wanted), "n").select("number")
