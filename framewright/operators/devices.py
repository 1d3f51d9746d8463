"""Distributions of devices: rates, streams, signal, 10 s buckets and peaks.

One pass over the frames counts them by device, second and rate; all else
comes from these counts, so that no device's frames are ever in one task. A
device's frames are those it sent and those it was sent; rates count where it
is the sender. The device ``*`` is the whole capture.

Nulls: a frame without a sender or receiver counts for the other only; one
without a rate is in totals alone; without a time it is in no bucket. A frame
sent to oneself counts twice. Ties of labels go to the one seen first, with
rate indices before legacy rates. No frames, no rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, dealt
from framewright.operators.stats import one_if, percent, second

# Seconds of a bucket; labels named of a bucket and of a second;
# peaks, and the least frames (exclusive) and retry share of one.
BUCKET, BUCKET_LABELS, SECOND_LABELS = 10, 5, 4
PEAKS, PEAK_FRAMES, PEAK_PERCENT = 3, 50, 10
MODERN = ("HT", "VHT", "HE", "EHT")
ALL = "*"
#: Parts of one device's counts; buckets listed in one step; what a time counts
#: for before a number.
PARTS, BLOCK, FIRST = 64, 4096, Decimal(10**19)


def counted(frames: DataFrame, devices: DataFrame) -> DataFrame:
    """Counts by device, second, side, subtype and rate; ``devices`` has ``mac``.

    ``key`` is the rate index or the legacy rate, ``label`` what it is called,
    ``first`` the earliest time and number as one figure, which aggregates by
    hashing hold. Counts, not frames, are looked up among the devices, dealt so
    that the whole capture's are in many tasks.
    """
    end = lambda mac, sent: F.struct(mac.alias("device"), F.coalesce(sent, F.lit(False)).alias("tx"))
    ends = F.array(end(F.col("ta"), F.lit(True)), end(F.col("ra"), F.col("ra") == F.col("ta")), end(F.lit(ALL), F.col("ta").isNotNull()))
    known = devices.select(F.col("mac").alias("device")).unionByName(devices.sparkSession.createDataFrame([(ALL,)], "device string"))
    modern = F.coalesce(F.col("mcs_phy").isin(*MODERN), F.lit(False))
    rate = F.nullif("data_rate", F.lit(""))
    rows = frames.select(F.explode(ends).alias("e"), second().alias("sec"), "subtype", "retry", "epoch_us", "number", "mcs", "nss", "rssi", modern.alias("modern"), "mcs_phy", rate.alias("rate")).select("e.*", "*").drop("e").where("device is not null")
    key = F.when(F.col("tx"), F.when(F.col("modern"), F.col("mcs").cast("string")).otherwise(F.col("rate")))
    rows = rows.withColumn("key", key)
    rated = F.col("key").isNotNull()
    sums = rows.groupBy(
        "device", "sec", "tx", "subtype", "key", F.when(rated, F.when(F.col("modern"), F.col("mcs_phy")).otherwise("Legacy")).alias("phy"), F.when(rated & F.col("modern"), F.col("nss")).alias("nss")
    ).agg(
        F.count("*").alias("n"), one_if(F.col("retry")).alias("retry"), F.min(F.col("epoch_us").cast("decimal(19,0)") * F.lit(FIRST) + F.col("number").cast("decimal(19,0)")).alias("first"),
        F.count(F.when(F.col("tx"), F.col("rssi"))).alias("heard"), F.sum(F.when(F.col("tx"), F.col("rssi"))).cast("long").alias("rssi"), F.min(F.when(F.col("tx"), F.col("rssi"))).alias("low"), F.max(F.when(F.col("tx"), F.col("rssi"))).alias("high"),
    )
    sums = sums.withColumn("part", F.pmod(F.xxhash64("sec", "subtype", "key"), F.lit(PARTS)).cast("int"))
    sums = sums.join(known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["device", "part"], "left_semi").drop("part")
    label = F.when(F.col("phy") == "Legacy", F.concat(F.lit("Legacy "), "key", F.lit("Mbps"))).when(F.col("phy").isNotNull(), F.concat("phy", F.lit(" MCS"), "key"))
    return settled(sums.withColumn("label", label), "device-seconds")


def _listed(counts: DataFrame, keys: list[str], label: Column, name: str) -> DataFrame:
    """Labels and their counts as text, in the order of labels."""
    sums = counts.withColumn("l", label).where("l is not null").groupBy(*keys, "l").agg(F.sum("n").alias("n"))
    return sums.groupBy(*keys).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("l", "n"))), lambda x: F.concat(x["l"], F.lit("×"), F.format_number(x["n"], 0)))).alias(name))


def profiles(counts: DataFrame) -> DataFrame:
    """A row a device: totals, sent frames, types, formats and signal."""
    sums = counts.groupBy("device").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("tx"), F.col("n")).otherwise(0)).alias("tx_total"), F.sum("retry").alias("retry"), percent(F.sum("retry"), F.sum("n"), 1).alias("retry_pct"),
        F.min("low").cast("long").alias("min_rssi"), F.max("high").cast("long").alias("max_rssi"), F.round(F.sum("rssi") / F.nullif(F.sum("heard"), F.lit(0)), 1).alias("avg_rssi"), F.sum("heard").alias("heard"),
    )
    types = _listed(counts, ["device"], P.frame_type(F.col("subtype")), "types")
    return sums.join(types, "device", "left").join(_listed(counts, ["device"], F.col("phy"), "formats"), "device", "left")


def rates(counts: DataFrame) -> DataFrame:
    """Sent frames and retries by format and rate, and by streams where known.

    ``nss`` is null in rows of a rate as a whole.
    """
    sent = counts.where("key is not null")
    sums = lambda *by: sent.groupBy("device", "phy", "key", *by).agg(F.sum("n").alias("total"), F.sum("retry").alias("retry"), percent(F.sum("retry"), F.sum("n"), 1).alias("retry_pct"))
    return sums().withColumn("nss", F.lit(None).cast("int")).unionByName(sums("nss").where("nss is not null"))


def _breakdown(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Totals of a span and its ``k`` commonest labels."""
    labels = counts.groupBy(*keys, "label", "phy").agg(
        F.sum("n").alias("n"), F.sum("retry").alias("retry"), F.min("first").alias("first"),
        F.sum(F.when(F.col("tx"), F.col("n")).otherwise(0)).alias("tx"), F.sum(F.when(F.col("phy") != "Legacy", F.col("key").cast("long") * F.col("n"))).alias("mcs"),
    )
    rank = F.struct(-F.col("n"), F.col("phy") == "Legacy", "first", "label", "n")
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), rank))), 1, k)
    legacy, modern = F.col("phy") == "Legacy", F.col("phy").isNotNull() & (F.col("phy") != "Legacy")
    sums = labels.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("retry").alias("retry"), percent(F.sum("retry"), F.sum("n"), 1).alias("retry_pct"), F.sum("tx").alias("tx_total"),
        F.concat_ws(", ", F.transform(top, lambda x: F.concat(x["label"], F.lit("×"), F.format_number(x["n"], 0)))).alias("breakdown"),
        F.round(F.sum("mcs") / F.nullif(F.sum(F.when(modern, F.col("n"))), F.lit(0)), 1).alias("avg_mcs"),
        F.coalesce(percent(F.sum(F.when(legacy, F.col("n")).otherwise(0)), F.sum("tx"), 1), F.lit(0.0)).alias("legacy_pct"),
    )
    return sums


def _spanned(counts: DataFrame, cap: int | None) -> DataFrame:
    """Counts with the ``start`` of their bucket, which a device's first second
    begins, and the first and last second ``a`` and ``b``. With a ``cap`` (in
    seconds) devices of a longer span have none. Dealt as in :func:`counted`."""
    spans = counts.where("sec is not null").groupBy("device").agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    spans = spans if cap is None else spans.where(F.col("b") - F.col("a") <= cap)
    cut = counts.where("sec is not null").withColumn("part", F.pmod(F.xxhash64("sec", "subtype", "key"), F.lit(PARTS)).cast("int"))
    start = F.col("a") + BUCKET * F.floor((F.col("sec") - F.col("a")) / BUCKET)
    return cut.join(spans.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["device", "part"]).drop("part").withColumn("start", start.cast("long"))


def _starts(cut: DataFrame) -> DataFrame:
    """Starts of all buckets of devices, block by block, so that a long span
    is neither one row's list nor one task's work."""
    block = F.lit(BLOCK * BUCKET).cast("long")
    blocks = cut.select("device", "a", "b").distinct().select("device", "b", F.explode(F.sequence("a", "b", block)).alias("first"))
    end = F.least("b", F.col("first") + block - BUCKET)
    return dealt(blocks, "device", "first").select("device", F.explode(F.sequence("first", end, F.lit(BUCKET).cast("long"))).alias("start"))


def buckets(counts: DataFrame, cap: int | None = None) -> DataFrame:
    """Each device's 10 s buckets from its first second on, empty ones too."""
    cut = _spanned(counts, cap)
    found = _breakdown(cut, ["device", "start"], BUCKET_LABELS)
    full = _starts(cut).join(found, ["device", "start"], "left").na.fill(0, ["total", "retry", "tx_total"]).na.fill(0.0, ["retry_pct", "legacy_pct"]).na.fill("", ["breakdown"])
    return full.join(_listed(cut, ["device", "start"], F.col("phy"), "formats"), ["device", "start"], "left").na.fill("", ["formats"])


def peaks(counts: DataFrame, cap: int | None = None) -> DataFrame:
    """The seconds of each device's three buckets of the highest retry share.

    Buckets of over 50 frames and 10 % count; of equal shares the earlier is
    higher. Seconds without frames are left out. Places beyond the third are
    dropped in each task before a device's are put together.
    """
    cut = _spanned(counts, cap)
    sums = cut.groupBy("device", "start").agg(F.sum("n").alias("peak_total"), percent(F.sum("retry"), F.sum("n"), 1).alias("peak_pct")).where((F.col("peak_total") > PEAK_FRAMES) & (F.col("peak_pct") >= PEAK_PERCENT))
    place = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("peak_pct"), "start"))
    best = sums.withColumn("place", place).where(F.col("place") <= PEAKS).withColumn("place", F.col("place").cast("long"))
    inside = cut.join(best, ["device", "start"])
    return _breakdown(inside, ["device", "start", "place", "peak_total", "peak_pct", "sec"], SECOND_LABELS).drop("avg_mcs", "legacy_pct")
