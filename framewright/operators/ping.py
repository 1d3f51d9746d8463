"""Echo requests and replies: pairing, loss, streaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import frames as P
from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, islands, range_join, slices
from framewright.operators.stats import one_if, percent, second

# Reply window and timeout, widest gap of sequence numbers
# that counts, pause that ends a streak and its least length.
WINDOW_US, TIMEOUT_US = 30 * SECOND, SECOND
MAX_GAP, STREAK_US, STREAK_LEAST = 1000, 2 * SECOND, 2
FLOW = ["src", "dst", "ident"]


def echoes(frames: DataFrame) -> DataFrame:
    """Requests and replies by flow; a reply's flow is its request's."""
    req = P.is_request()
    return frames.where(req | P.is_reply()).select(
        F.when(req, "req").otherwise("rep").alias("side"),
        F.when(req, F.col("ip_src")).otherwise(F.col("ip_dst")).alias("src"),
        F.when(req, F.col("ip_dst")).otherwise(F.col("ip_src")).alias("dst"),
        F.col("icmp_ident").alias("ident"),
        "icmp_seq",
        "epoch_us",
        "number",
        "retry",
        F.when(req, F.col("ta")).otherwise(F.col("ra")).alias("sta"),
        "rssi",
    )


def _first_sends(rows: pd.DataFrame, keys: list[str], window_us: int) -> pd.DataFrame:
    """Rows of runs that are a window or more after the last one kept."""
    line = rows.sort_values([*keys, "epoch_us", "number"], kind="stable", na_position="first")
    same = line[keys].fillna("").astype(str).agg("\0".join, axis=1).to_numpy()
    keep, held, last = [], None, 0
    for key, t in zip(same, line["epoch_us"].tolist()):
        keep.append(key != held or t - last >= window_us)
        if keep[-1]:
            held, last = key, t
    return line[keep]


def dedup(frames: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """First sends: repeats within the window of the last kept one go.

    Kept rows anchor the window, so a chain of repeats is not followed. Rows
    are first cut where nothing came for a whole window, which always starts
    anew. A run shorter than the window keeps its first row; only longer ones,
    of numbers that keep repeating, are gone through in order. The result is a
    table, as every use reads it more than once.
    """
    keys, columns = ["side", *FLOW, "icmp_seq"], ["epoch_us", "number", "retry", "sta", "rssi"]
    runs = islands(echoes(frames), keys, ["epoch_us", "number"], window_us, at_least=True)
    by = Window.partitionBy(*keys, "island")
    told = runs.withColumns({"long": F.max("epoch_us").over(by) - F.col("island") >= window_us, "first": F.row_number().over(by.orderBy("epoch_us", "number")) == 1})
    short = told.where(~F.col("long") & F.col("first")).select(*keys, *columns)
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    chains = slices(told.where("long").select(*keys, *columns, "island"), keys, 16)
    kept = chains.applyInPandas(lambda part: _first_sends(part, keys, window_us)[[*keys, *columns]], ", ".join(f"{c} {kinds[c]}" for c in (*keys, *columns)))
    return settled(short.unionByName(kept), "echoes")


def _paired(events: Column, window_us: int) -> Column:
    """Pairs (req, rep, at) of time-ordered events: each reply answers the
    earliest request still open, and a request is open for the window."""
    start = F.struct(F.filter(events, lambda e: F.lit(False)).alias("open"), F.array().cast("array<struct<req:bigint,rep:bigint,at:bigint>>").alias("pairs"))

    def step(acc: Column, e: Column) -> Column:
        live = F.filter(acc["open"], lambda o: e["t"] - o["t"] <= window_us)
        asked = F.struct(F.concat(live, F.array(e)).alias("open"), acc["pairs"].alias("pairs"))
        pair = F.struct(F.get(live, F.lit(0))["number"].alias("req"), e["number"].alias("rep"), e["t"].alias("at"))
        answered = F.struct(F.slice(live, 2, F.greatest(F.size(live), F.lit(1))).alias("open"), F.concat(acc["pairs"], F.array(pair)).alias("pairs"))
        unused = F.struct(live.alias("open"), acc["pairs"].alias("pairs"))
        return F.when(e["side"] == 0, asked).when(F.size(live) > 0, answered).otherwise(unused)

    return F.aggregate(events, start, step, lambda acc: acc["pairs"])


def matches(frames: DataFrame, window_us: int = WINDOW_US, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """Every first request with its reply, if any: status matched or late."""
    return matched(dedup(frames, window_us), window_us, timeout_us)


def matched(rows: DataFrame, window_us: int = WINDOW_US, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """As :func:`matches`, from first sends.

    First sends of a key are a window apart, so the first reply within the
    window is a request's own, except where one comes exactly a window after
    it, as another request's would at once: such keys are paired in order, one
    to one, the earliest request first.
    """
    keys = [*FLOW, "icmp_seq"]
    req = rows.where("side = 'req'").select(*keys, "epoch_us", F.col("number").alias("req_num"), "sta", "retry", "rssi")
    asked = req.select(*keys, F.col("epoch_us").alias("t"), "req_num")
    rep = rows.where("side = 'rep'").select(*keys, F.col("epoch_us").alias("rep_us"), F.col("number").alias("rep_num"))
    near = range_join(asked, rep, keys, "rep_us", 0, window_us)
    edge = near.where(F.col("rep_us") - F.col("t") == window_us).select(*keys).distinct()
    plain = near.join(edge, keys, "left_anti").groupBy("req_num").agg(F.min(F.struct("rep_us", "rep_num")).alias("r")).select("req_num", F.col("r.rep_num").alias("rep_num"), F.col("r.rep_us").alias("rep_us"))
    event = F.struct(F.col("epoch_us").alias("t"), F.when(F.col("side") == "req", 0).otherwise(1).alias("side"), "number")
    runs = islands(rows.join(edge, keys, "left_semi"), keys, ["epoch_us", "side", "number"], window_us)
    chained = runs.groupBy(*keys, "island").agg(F.explode(_paired(F.sort_array(F.collect_list(event)), window_us)).alias("p")).select(F.col("p.req").alias("req_num"), F.col("p.rep").alias("rep_num"), F.col("p.at").alias("rep_us"))
    rtt = F.col("rep_us") - F.col("epoch_us")
    return req.join(plain.unionByName(chained), "req_num", "left").select(*keys, "epoch_us", "req_num", "sta", "retry", "rssi", "rep_num", rtt.alias("rtt_us"), F.when(rtt <= timeout_us, "matched").when(rtt.isNotNull(), "late").alias("status"))


def statuses(frames: DataFrame) -> DataFrame:
    """As :func:`matches`, with loss and, where only requests were seen, none.

    Loss: the flow has replies, but none of this sequence number. A request
    out of range of a reply that exists has no status.
    """
    rows = dedup(frames)
    seqs = rows.where("side = 'rep'").select(*FLOW, "icmp_seq").distinct().withColumn("has_seq", F.lit(True))
    flows = rows.where("side = 'rep'").select(*FLOW).distinct().withColumn("has_flow", F.lit(True))
    found = matched(rows).join(seqs, [*FLOW, "icmp_seq"], "left").join(flows, FLOW, "left")
    lost = F.col("has_flow") & F.col("has_seq").isNull()
    return settled(found.withColumn("status", F.coalesce("status", F.when(lost, "loss"))).drop("has_seq", "has_flow"), "statuses")


def cross_validation(frames: DataFrame) -> DataFrame:
    """Sequence numbers of flows seen in both, one or neither direction.

    Numbers are compared as a full outer join of distinct keys; gaps in the
    union count as unobserved.
    """
    rows = dedup(frames).where(F.col("icmp_seq").isNotNull())
    sides = rows.groupBy(*FLOW, "icmp_seq").agg(F.max(F.col("side") == "req").alias("req"), F.max(F.col("side") == "rep").alias("rep"))
    step = F.col("icmp_seq") - F.lag("icmp_seq").over(Window.partitionBy(*FLOW).orderBy("icmp_seq"))
    gap = sides.withColumn("gap", F.when((step > 1) & (step <= MAX_GAP), step - 1).otherwise(0))
    return gap.groupBy(*FLOW).agg(one_if(F.col("req") & F.col("rep")).alias("verified"), one_if(F.col("req") & ~F.col("rep")).alias("reply_missing"), one_if(F.col("rep") & ~F.col("req")).alias("request_missing"), F.sum("gap").cast("long").alias("unobserved"))


def seq_gap_loss(rows: DataFrame) -> DataFrame:
    """Missing numbers of one-sided flows, each with its anchor row.

    ``rows`` are first sends of one side; the anchor is the nearest lower
    number seen.
    """
    seqs = rows.where(F.col("icmp_seq").isNotNull()).groupBy(*FLOW, "icmp_seq").agg(F.min(F.struct("epoch_us", "number")).alias("anchor"))
    nxt = F.lead("icmp_seq").over(Window.partitionBy(*FLOW).orderBy("icmp_seq"))
    step = F.col("next") - F.col("icmp_seq")
    holes = seqs.withColumn("next", nxt).where((step > 1) & (step <= MAX_GAP))
    return holes.select(*FLOW, F.explode(F.sequence(F.col("icmp_seq") + 1, F.col("next") - 1)).alias("missing_seq"), F.col("anchor.epoch_us").alias("anchor_us"), F.col("anchor.number").alias("anchor_num"))


def gap_losses(frames: DataFrame) -> DataFrame:
    """:func:`seq_gap_loss` over flows of which one side alone was seen."""
    rows = dedup(frames)
    sides = rows.groupBy(*FLOW).agg(F.min("side").alias("one"), F.max("side").alias("other")).where("one = other")
    direction = sides.select(*FLOW, F.when(F.col("one") == "req", "request").otherwise("reply").alias("direction"))
    return seq_gap_loss(rows.join(sides, FLOW, "left_semi")).join(direction, FLOW)


def observations(frames: DataFrame) -> DataFrame:
    """Echoes seen without what would measure them.

    Unanswered requests of flows without replies, replies of flows without
    requests, and replies whose number no request of the flow has.
    """
    rows = dedup(frames)
    has = rows.groupBy(*FLOW).agg(F.max(F.col("side") == "req").alias("asked"), F.max(F.col("side") == "rep").alias("answered"))
    flows = rows.join(has, FLOW)
    asked = rows.where("side = 'req' and icmp_seq is not null").select(*FLOW, "icmp_seq").distinct()
    open_ = flows.where("side = 'req' and not answered")
    lone = flows.where("side = 'rep' and not asked")
    missed = flows.where("side = 'rep' and asked and icmp_seq is not null").join(asked, [*FLOW, "icmp_seq"], "left_anti")
    told = lambda df, direction: df.select(*FLOW, "icmp_seq", "epoch_us", "number", "sta", "retry", "rssi", F.lit(direction).alias("direction"))
    return told(open_, "request").unionByName(told(lone, "reply")).unionByName(told(missed, "reply"))


def totals(frames: DataFrame) -> DataFrame:
    """One row: pairs, late, losses (with those of gaps), unmeasurable, and
    the shares of losses and of late or lost pings among them all."""
    found = statuses(frames)
    sums = found.agg(one_if(F.col("status").isin("matched", "late")).alias("pairs"), one_if(F.col("status") == "late").alias("late"), one_if(F.col("status") == "loss").alias("lost"))
    gaps = gap_losses(frames).agg(F.count("*").alias("gaps"))
    sides = dedup(frames).groupBy(*FLOW).agg(F.max(F.col("side") == "req").alias("q"), F.max(F.col("side") == "rep").alias("p"), F.count("*").alias("n"))
    open_ = sides.agg(F.coalesce(F.sum(F.when(~(F.col("q") & F.col("p")), F.col("n"))), F.lit(0)).alias("unmeasurable"))
    one = sums.crossJoin(gaps).crossJoin(open_)  # one row each
    losses = F.col("lost") + F.col("gaps")
    base = F.col("pairs") + losses + F.col("unmeasurable")
    return one.select("pairs", "late", losses.alias("losses"), "unmeasurable", percent(losses, base).alias("loss_pct"), percent(losses + F.col("late"), base).alias("timeout_pct"))


def loss_basis(wired: DataFrame, wireless: DataFrame) -> DataFrame:
    """The loss to judge by: of the wire where it saw exchanges, else of the air.

    ``wired`` and ``wireless`` are one row each, with loss_pct; the wire's has
    total, and partial where its capture was not read to the end. Without
    either, both results are null.
    """
    w = wired.select(F.col("loss_pct").alias("w_pct"), "total", "partial")
    both = wireless.select(F.col("loss_pct").alias("a_pct")).crossJoin(w)  # one row each
    usable = (F.coalesce("total", F.lit(0)) > 0) & ~F.coalesce("partial", F.lit(False)) & F.col("w_pct").isNotNull()
    return both.select(F.when(usable, F.col("w_pct")).otherwise(F.col("a_pct")).alias("loss_pct"), F.when(usable, "wired_ground_truth").when(F.col("a_pct").isNotNull(), "wireless_observed").alias("loss_basis"))


def devices(frames: DataFrame, roles: DataFrame) -> DataFrame:
    """Names of addresses that echoes tell, the last one told winning.

    Of an answered or lost request the sender's and the receiver's; ``roles``
    name MACs.
    """
    found = statuses(frames).where(F.col("status").isNotNull()).select("req_num", "epoch_us")
    sent = frames.where(P.is_request()).select(F.col("number").alias("req_num"), "ta", "ra", "ip_src", "ip_dst")
    ends = found.join(sent, "req_num").select("epoch_us", "req_num", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("ip_src").alias("ip"), F.col("ta").alias("mac")), F.struct(F.lit(1).alias("k"), F.col("ip_dst").alias("ip"), F.col("ra").alias("mac")))).alias("e"))
    named = ends.select("epoch_us", "req_num", "e.*").where("ip is not null and mac is not null").join(roles.select("mac", "name"), "mac", "left")
    return named.groupBy("ip").agg(F.max_by(P.mac_name(F.col("mac"), F.col("name")), F.struct("epoch_us", "req_num", "k")).alias("device"))


def ping_stats(frames: DataFrame) -> DataFrame:
    """Round trips by sender: extremes, average, quantiles by index, losses.

    The quantile q of n values is the value at index min(n - 1, int(n * q)).
    """
    found = statuses(frames)
    rtts = found.where("rtt_us is not null")
    place = Window.partitionBy("src").orderBy("rtt_us", "req_num")
    ranked = rtts.select("src", "rtt_us", (F.row_number().over(place) - 1).alias("i"), F.count("*").over(Window.partitionBy("src")).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))), F.col("rtt_us")))
    stats = ranked.groupBy("src").agg(F.count("*").alias("n"), F.min("rtt_us").alias("min_us"), F.max("rtt_us").alias("max_us"), F.round(F.avg("rtt_us"), 6).alias("avg_us"), at(0.5).alias("p50_us"), at(0.95).alias("p95_us"), at(0.99).alias("p99_us"))
    losses = found.groupBy("src").agg(one_if(F.col("status") == "loss").alias("losses"), one_if(F.col("status") == "late").alias("late"), one_if(F.col("status").isNotNull()).alias("judged"))
    return losses.join(stats, "src", "left").select("src", "n", "min_us", "max_us", "avg_us", "p50_us", "p95_us", "p99_us", "losses", "late", percent(F.col("losses"), F.col("judged")).alias("loss_pct"), percent(F.col("losses") + F.col("late"), F.col("judged")).alias("timeout_pct"))


def ping_per_sec(frames: DataFrame) -> DataFrame:
    """Loss and round trips of each second, by station and over all."""
    found = statuses(frames).where(F.col("status").isNotNull()).withColumn("sec", second())
    return found.groupingSets([["sec"], ["sec", "sta"]], "sec", "sta").agg(F.count("*").alias("total"), one_if(F.col("status") == "loss").alias("loss"), percent(one_if(F.col("status") == "loss"), F.count("*")).alias("loss_pct"), F.round(F.avg("rtt_us"), 6).alias("avg_rtt_us"), F.grouping_id().cast("long").alias("level"))


def streaks(frames: DataFrame, gap_us: int = STREAK_US, least: int = STREAK_LEAST) -> DataFrame:
    """Runs of losses of a station without a pause beyond the gap."""
    lost = statuses(frames).where("status = 'loss'").select("sta", "epoch_us", "req_num", "icmp_seq")
    runs = islands(lost, ["sta"], ["epoch_us", "req_num"], gap_us)
    found = runs.groupBy("sta", "island").agg(F.count("*").alias("n"), F.max("epoch_us").alias("end_us"), F.min_by("icmp_seq", F.struct("epoch_us", "req_num")).alias("first_seq"), F.max_by("icmp_seq", F.struct("epoch_us", "req_num")).alias("last_seq"))
    return found.where(F.col("n") >= least).select("sta", F.col("island").alias("start_us"), "end_us", "n", "first_seq", "last_seq")


def loss_cause(frames: DataFrame) -> DataFrame:
    """What was on the air about each loss: roaming, retries or weak signal.

    All frames within a second, whose ever; a roaming frame less than two off
    comes first, then retries over 60 %, signal under -75 dBm, retries over 30 %.
    """
    lost = statuses(frames).where("status = 'loss'").select("sta", F.col("epoch_us").alias("t"), "req_num", F.lit(0).alias("g"))
    own = frames.select(F.lit(0).alias("g"), "epoch_us", "retry", "rssi", P.is_roaming().alias("roam"))
    near = range_join(lost, own, ["g"], "epoch_us", -2 * SECOND, 2 * SECOND)
    close = F.abs(F.col("epoch_us") - F.col("t")) <= SECOND
    seen = near.groupBy("sta", "t", "req_num").agg(
        percent(one_if(close & F.col("retry")), one_if(close)).alias("retry_pct"),
        F.round(F.avg(F.when(close, F.col("rssi"))), 6).alias("avg_rssi"),
        F.max(F.col("roam") & (F.abs(F.col("epoch_us") - F.col("t")) < 2 * SECOND)).alias("roam"),
    )
    cause = F.when(F.col("roam"), "roaming").when(F.col("retry_pct") > 60, "high_retry").when(F.col("avg_rssi") < -75, "weak_signal").when(F.col("retry_pct") > 30, "retry").otherwise("unknown")
    return lost.join(seen, ["sta", "t", "req_num"], "left").select("sta", F.col("t").alias("epoch_us"), "req_num", "retry_pct", "avg_rssi", cause.alias("cause"))


def capture_mode(frames: DataFrame) -> DataFrame:
    """bidirectional, mixed, unidirectional or none."""
    flows = dedup(frames).groupBy(*FLOW).agg(F.max(F.col("side") == "req").alias("req"), F.max(F.col("side") == "rep").alias("rep"))
    n = flows.agg(one_if(F.col("req") & F.col("rep")).alias("both"), one_if(F.col("req")).alias("req"), F.count("*").alias("any"))
    return n.select(F.when((F.col("both") > 0) & (F.col("both") == F.col("req")), "bidirectional").when(F.col("both") > 0, "mixed").when(F.col("any") > 0, "unidirectional").otherwise("none").alias("mode"))
