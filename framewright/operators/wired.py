"""Ground truth from a wired capture: one sender's exchanges and their loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, islands, overlap_join, range_join
from framewright.operators.ping import STREAK_LEAST, STREAK_US
from framewright.operators.stats import one_if, percent, roles

LATE_US = 5 * SECOND
#: Within this of a loss streak, roaming and retries are its context.
CONTEXT_US = 2 * SECOND


def packets(frames: DataFrame) -> DataFrame:
    """Echo packets: side, host that asks, target, identifier, number, and
    whether they were heard in the air."""
    req = P.is_request()
    return frames.where(req | P.is_reply()).select(F.when(req, "req").otherwise("rep").alias("side"), F.when(req, F.col("ip_src")).otherwise(F.col("ip_dst")).alias("host"), F.when(req, F.col("ip_dst")).otherwise(F.col("ip_src")).alias("target"), F.col("icmp_ident").alias("ident"), F.col("icmp_seq").alias("seq"), "epoch_us", "number", F.col("subtype").isNotNull().alias("wlan"))


def cohort(rows: DataFrame, start_us: int | None = None, end_us: int | None = None, ip_sets: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Requests of a half-open time range that touch every one of the sets."""
    found = rows.where("side = 'req'")
    if start_us is not None:
        found = found.where(F.col("epoch_us") >= start_us)
    if end_us is not None:
        found = found.where(F.col("epoch_us") < end_us)
    for ips in ip_sets:
        found = found.where(F.col("host").isin(*ips) | F.col("target").isin(*ips))
    return found


def sender(rows: DataFrame) -> DataFrame:
    """The host with the most requests; ties go to the first seen."""
    seen = rows.where("side = 'req'").groupBy("host").agg(F.count("*").alias("n"), F.min(F.struct("epoch_us", "number")).alias("first"))
    return seen.orderBy(F.desc("n"), "first").limit(1).select("host", "n")


def wireless_guard(rows: DataFrame) -> DataFrame:
    """How many of the sender's requests were heard in the air.

    All: the capture is none of the wire (``error``), since what the monitor
    missed would count as lost. Some: ``warning``.
    """
    own = rows.where("side = 'req'").join(F.broadcast(sender(rows).select("host")), "host", "left_semi")  # one row
    sums = own.groupBy("host").agg(F.count("*").alias("requests"), one_if(F.col("wlan")).alias("wireless"))
    return sums.withColumn("verdict", F.when(F.col("wireless") == F.col("requests"), "error").when(F.col("wireless") > 0, "warning").otherwise("ok"))


def exchanges(rows: DataFrame, timeout_us: int = SECOND, late_us: int = LATE_US) -> DataFrame:
    """Requests with the first reply within reach; replies are not used up.

    ``rtt_us`` is set within the timeout, ``late_us`` beyond it up to the late
    window, unless the next request of the key came before.
    """
    keys = ["host", "target", "ident", "seq"]
    nxt = F.lead("epoch_us").over(Window.partitionBy(*keys).orderBy("epoch_us", "number"))
    asked = rows.where("side = 'req'").withColumn("next_us", nxt)
    req = asked.select(*keys, F.col("epoch_us").alias("t"), "number", "next_us")
    rep = rows.where("side = 'rep'").select(*keys, F.col("epoch_us").alias("rep_us"))
    best = range_join(req, rep, keys, "rep_us", 0, max(timeout_us, late_us)).groupBy("number").agg(F.min("rep_us").alias("rep_us"))
    d = F.col("rep_us") - F.col("t")
    late = (d > timeout_us) & (F.col("next_us").isNull() | (F.col("rep_us") < F.col("next_us")))
    return req.join(best, "number", "left").select(*keys, F.col("t").alias("epoch_us"), "number", F.when(d <= timeout_us, d).alias("rtt_us"), F.when(late, d).alias("late_us"))


def of_sender(rows: DataFrame) -> DataFrame:
    """Packets of the sender alone."""
    return rows.join(F.broadcast(sender(rows).select("host")), "host", "left_semi")  # one row


def without_tail(found: DataFrame, rows: DataFrame, timeout_us: int = SECOND) -> DataFrame:
    """Drops unanswered requests that the capture's end left no time for."""
    end = rows.agg(F.max("epoch_us").alias("end_us"))
    open_ = F.col("rtt_us").isNull() & F.col("late_us").isNull() & (F.col("epoch_us") > F.col("end_us") - timeout_us)
    return found.crossJoin(F.broadcast(end)).where(~open_).drop("end_us")  # one row


def without_trailing_run(found: DataFrame) -> DataFrame:
    """Drops what follows the last answered request."""
    last = found.where("rtt_us is not null").agg(F.max("epoch_us").alias("last_us"))
    return found.crossJoin(F.broadcast(last)).where("epoch_us <= last_us").drop("last_us")  # one row


def within(found: DataFrame, start_us: int | None, end_us: int | None, ip_sets: Sequence[Sequence[str]] = (), timeout_us: int = SECOND) -> DataFrame:
    """Requests of a time range whose outcome lies inside it too.

    Sets of addresses narrow the targets one after another; a set that holds
    the sender narrows nothing.
    """
    if start_us is not None:
        found = found.where(F.col("epoch_us") >= start_us)
    if end_us is not None:
        reply = F.col("epoch_us") + F.coalesce("rtt_us", "late_us")
        found = found.where((F.col("epoch_us") < end_us) & ~((F.col("epoch_us") >= end_us - timeout_us) & (reply.isNull() | (reply >= end_us))))
    for ips in ip_sets:
        found = found.where(F.col("host").isin(*ips) | F.col("target").isin(*ips))
    return found


def ground_truth(frames: DataFrame) -> DataFrame:
    """Totals, losses and round trips of the sender, by target.

    p95 is by nearest rank.
    """
    rows = of_sender(packets(frames))
    found = without_tail(exchanges(rows), rows)
    ranked = found.withColumn("i", F.row_number().over(Window.partitionBy("target").orderBy(F.col("rtt_us").asc_nulls_last(), "number"))).withColumn("n_ok", F.count("rtt_us").over(Window.partitionBy("target")))
    return ranked.groupBy("host", "target").agg(
        F.count("*").alias("total"),
        F.count("rtt_us").alias("ok"),
        (F.count("*") - F.count("rtt_us")).alias("ng"),
        F.count("late_us").alias("late"),
        percent(F.count("*") - F.count("rtt_us"), F.count("*")).alias("loss_pct"),
        F.round(F.avg("rtt_us"), 6).alias("avg_us"),
        F.max(F.when(F.col("i") == F.ceil(0.95 * F.col("n_ok")), F.col("rtt_us"))).alias("p95_us"),
    )


def loss_streaks(frames: DataFrame) -> DataFrame:
    """Runs of unanswered requests of the sender."""
    rows = of_sender(packets(frames))
    lost = without_tail(exchanges(rows), rows).where("rtt_us is null")
    runs = islands(lost, ["target"], ["epoch_us", "number"], STREAK_US)
    return runs.groupBy("host", "target", "island").agg(F.max("epoch_us").alias("end_us"), F.count("*").alias("n")).where(F.col("n") >= STREAK_LEAST).select("host", "target", F.col("island").alias("start_us"), "end_us", "n")


def loss_context(frames: DataFrame) -> DataFrame:
    """Loss streaks and what the air had within two seconds of them.

    The frames that count are those of the station behind the target, else
    behind the host, as senders of the addresses tell; where neither is a
    station's, all frames count.
    """
    sta = roles(frames).where("role = 'STA'").select("mac")
    seen = frames.where(F.col("ip_src").isNotNull() & F.col("ta").isNotNull()).groupBy("ip_src", "ta").agg(F.count("*").alias("n"))
    bound = seen.groupBy(F.col("ip_src").alias("ip")).agg(F.max_by("ta", F.struct("n", "ta")).alias("mac")).join(sta, "mac", "left_semi")
    of = lambda c: bound.select(F.col("ip").alias(c), F.col("mac").alias(f"{c}_sta"))
    found = settled(loss_streaks(frames).join(of("target"), "target", "left").join(of("host"), "host", "left").withColumn("sta", F.coalesce("target_sta", "host_sta", F.lit("*"))), "streaks")
    spans = found.select("host", "target", "sta", "start_us", "n", (F.col("start_us") - CONTEXT_US).alias("l_start"), (F.col("end_us") + CONTEXT_US).alias("l_end"))
    air = frames.select(F.explode(F.array_distinct(F.array(F.lit("*"), "ta", "ra"))).alias("sta"), F.col("epoch_us").alias("r_start"), F.col("epoch_us").alias("r_end"), "retry", P.is_roaming().alias("roam"))
    near = overlap_join(spans, air.where(F.col("sta").isNotNull()), ["sta"]).groupBy("host", "target", "start_us").agg(F.count("*").alias("frames"), one_if(F.col("roam")).alias("roaming"), percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"))
    return spans.select("host", "target", "sta", "start_us", "n").join(near, ["host", "target", "start_us"], "left").na.fill(0, ["frames", "roaming"])


def exping_rows(found: DataFrame) -> DataFrame:
    """Result lines of exchanges: OK or NG, status text, target.

    The status shows whole milliseconds of the round trip and 0.276 ms.
    """
    status = F.when(F.col("rtt_us").isNotNull(), F.format_string("Time:%6dms", F.floor((F.col("rtt_us") + 276) / 1000))).otherwise("Request timed out")
    return found.select(F.when(F.col("rtt_us").isNotNull(), "OK").otherwise("NG").alias("result"), "epoch_us", F.col("target").alias("ip"), status.alias("status"))


