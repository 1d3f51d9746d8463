"""A second way to the roams, to hold the first against.

:func:`ledger` pairs associations from frames alone: stations are whoever sent
association requests, and each run of a station's events is folded with array
functions in the JVM, where :mod:`framewright.operators.roaming` walks it in a
grouped function. :func:`correlated` joins it with the logs' roams and lists
what either side has alone; :func:`compared` lists where two results differ.
Without differences both rules say the same of a capture.

Nulls: events without a sender, receiver or time take no part. Ties: in order
of time and number.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.tables import settled
from framewright.operators.joins import asof_backward, free, islands, slices
from framewright.operators.roaming import AFTER_US, ATTEMPT_US, EXCHANGE_US, PAIR_US, pieces, slow_by

# Tolerance of logs, and of another result's times.
LOG_US, RESULT_US = 250_000, 50_000


def usable(mac: Column) -> Column:
    """Whether an address can be a station's: six bytes, not zero, no group."""
    return F.coalesce(mac.rlike("^[0-9a-f]{2}(:[0-9a-f]{2}){5}$") & (mac != "00:00:00:00:00:00") & (F.conv(F.substring(mac, 1, 2), 16, 10).cast("int") % 2 == 0), F.lit(False))


def senders(frames: DataFrame) -> DataFrame:
    """Addresses that sent association or reassociation requests."""
    return frames.where(F.col("subtype").isin(0, 2) & usable(F.col("ta"))).select(F.col("ta").alias("sta")).distinct()


def _folded(steps: str) -> Column:
    """Associations of one run's events, in order, with their anchors.

    The state holds the authentications per AP that still count, the last
    association, and what has been found.
    """
    anchor, found = "struct<ap:string,t:bigint,n:bigint,basis:string>", "struct<ap:string,t:bigint,n:bigint,anchor:struct<ap:string,t:bigint,n:bigint,basis:string>>"
    live = f"filter(a.held, y -> x.t - y.t <= {PAIR_US})"
    mine = f"try_element_at(filter(a.held, y -> x.t - y.t <= {PAIR_US} and y.ap = x.ap), 1)"
    others = f"filter(a.held, y -> x.t - y.t <= {PAIR_US} and y.ap <> x.ap)"
    state = lambda held, t, s, ap, out: f"named_struct('held', {held}, 't', {t}, 's', {s}, 'ap', {ap}, 'out', {out})"
    keep = ("a.t", "a.s", "a.ap", "a.out")
    begun = f"x.kind = 'request' or {mine} is null or x.t - {mine}.t > {EXCHANGE_US}"
    again = f"{mine} is null and coalesce(x.t - a.t between 0 and {ATTEMPT_US} and a.s = x.s and a.ap = x.ap, false)"
    step = f"""case when x.kind = 'seed' then {state(f"cast(array() as array<{anchor}>)", "x.t", "x.s", "x.ap", "a.out")}
      when x.kind <> 'assoc' then {state(f"case when {begun} then concat({others}, array(named_struct('ap', x.ap, 't', x.t, 'n', x.n, 'basis', x.kind))) else {live} end", *keep)}
      when {again} then {state(others, *keep)}
      else {state(f"cast(array() as array<{anchor}>)", "x.t", "x.s", "x.ap", f"concat(a.out, array(named_struct('ap', x.ap, 't', x.t, 'n', x.n, 'anchor', {mine})))")} end"""
    start = state(f"cast(array() as array<{anchor}>)", "cast(null as bigint)", "cast(null as int)", "cast(null as string)", f"cast(array() as array<{found}>)")
    return F.expr(f"aggregate({steps}, {start}, (a, x) -> {step}).out")


def ledger(frames: DataFrame) -> DataFrame:
    """Roams with their authentication, the time to message 4 and a verdict.

    sta, ap, assoc_us, assoc_num, auth_us, auth_num, basis, gap_us, total_us
    (authentication to the first message 4 within five seconds).
    """
    sta = settled(senders(frames), "senders")
    known = frames.where(F.col("subtype").isin(0, 2, 11)).select("ta", "ra", "subtype", "epoch_us", "number")
    sent = known.join(sta, F.col("ta") == F.col("sta")).select("sta", F.col("ra").alias("ap"), F.when(F.col("subtype") == 11, "request").otherwise("assoc").alias("kind"), "subtype", "epoch_us", "number")
    got = known.where("subtype = 11").join(sta, F.col("ra") == F.col("sta")).select("sta", F.col("ta").alias("ap"), F.lit("response").alias("kind"), "subtype", "epoch_us", "number")
    got = got.join(sta.select(F.col("sta").alias("ap")), "ap", "left_anti").select(sent.columns)
    runs = pieces(sent.unionByName(got), F.col("kind") == "assoc")
    row = F.struct(F.col("epoch_us").alias("t"), F.col("number").alias("n"), "ap", "kind", F.col("subtype").alias("s"))
    lists = runs.groupBy("sta", "island").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    pairs = lists.select("sta", F.explode(_folded("steps")).alias("f")).select("sta", "f.ap", F.col("f.t").alias("assoc_us"), F.col("f.n").alias("assoc_num"), F.col("f.anchor.t").alias("auth_us"), F.col("f.anchor.n").alias("auth_num"), F.col("f.anchor.basis").alias("basis"))
    pairs = settled(pairs, "ledger")
    last = frames.where("eapol_msgnr = 4").select(F.col("ta").alias("sta"), F.col("ra").alias("ap"), (-F.col("epoch_us")).alias("back"), F.col("epoch_us").alias("four_us"))
    ahead = asof_backward(pairs.withColumn("t", -F.col("assoc_us")), last, ["sta", "ap"], "back", "four_us")  # the first at or after
    met = F.col("ap").isNotNull() & (F.col("four_us") <= F.col("assoc_us") + AFTER_US)
    return ahead.withColumn("total_us", F.when(met, F.col("four_us") - F.col("auth_us"))).withColumn("gap_us", F.col("assoc_us") - F.col("auth_us")).select("sta", "ap", "assoc_us", "assoc_num", "auth_us", "auth_num", "basis", "gap_us", "total_us")


def judged(roams: DataFrame) -> DataFrame:
    """``roams`` with is_slow and slow_basis, by the log's total
    (sta_total_ms) where there is one, else the capture's, else the gap."""
    slow, basis = slow_by(F.col("sta_total_ms"), F.col("total_us") / 1000, F.col("gap_us") / 1000)
    return roams.withColumns({"is_slow": slow, "slow_basis": basis})


def _in_order(rows: pd.DataFrame, reach_us: int) -> pd.DataFrame:
    """One-to-one pairs: each left row in order takes its nearest free one.

    Places are distinct times with what is left of their rows; taken up, they
    link on to their free neighbours.
    """
    places, out = {}, []
    for kind, own in rows[rows["kind"] >= 0].sort_values(["p", "id"]).groupby("kind"):
        at, first = np.unique(own["p"].to_numpy(), return_index=True)
        n = len(at)
        places[kind] = at.tolist(), own["id"].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], list(range(n + 1)), list(range(n + 1))
    left = rows[rows["kind"] < 0].drop_duplicates(["left_us", "id"]).sort_values(["left_us", "id"])
    for line, times in zip(left["id"].tolist(), left["at"].tolist(), strict=True):
        near = []
        for kind, t in enumerate(times):
            if kind not in places or t is None or t != t:
                continue
            at, ids, first, _, later, sooner = places[kind]
            n, place = len(at), bisect_left(at, t)
            for k in (n - 1 - free(sooner, n - place), free(later, place)):  # sooner: places from the end
                if 0 <= k < n and abs(at[k] - t) <= reach_us:
                    near.append((abs(at[k] - t), ids[first[k]], at[k] - int(t), kind, k))
        if near:
            _, right, far, kind, k = min(near)
            at, _, first, end, later, sooner = places[kind]
            first[k] += 1
            if first[k] == end[k]:
                later[k], sooner[len(at) - 1 - k] = k + 1, len(at) - k
            out.append((line, right, far))
    return pd.DataFrame(out, columns=["left_id", "right_id", "far"]).astype("int64")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], reach_us: int) -> DataFrame:
    """Pairs (left_id, right_id, far), each left row in order (left_us,
    left_id) with the nearest right row within reach that is free.

    ``left``: keys, left_us, left_id, ``at`` (its time for each kind of right
    row, null: none). ``right``: keys, ``kind`` (from 0), air_us, right_id. Of
    two as near the smaller right_id. Groups hold rows, not their pairs, and
    end at pauses; a left row lasts from its first time to its last.
    """
    pause = max(reach_us, PAIR_US)
    low, high = F.array_min("at"), F.array_max("at")
    lasting = F.array_distinct(F.concat(F.sequence(low, high, F.lit(pause)), F.array(high)))
    ours = left.where(low.isNotNull()).select(*keys, F.lit(-1).alias("kind"), F.col("left_id").alias("id"), "left_us", "at", F.explode(lasting).alias("p"))
    theirs = right.select(*keys, F.col("kind").cast("int").alias("kind"), F.col("right_id").alias("id"), F.lit(None).cast("long").alias("left_us"), F.lit(None).cast("array<bigint>").alias("at"), F.col("air_us").alias("p"))
    rows = ours.unionByName(theirs).dropna(subset=[*keys, "p"])
    return slices(islands(rows, keys, ["p", "kind", "id"], pause), keys).applyInPandas(lambda x: _in_order(x, reach_us), "left_id long, right_id long, far long")


def correlated(commands: DataFrame, roams: DataFrame) -> DataFrame:
    """Logs' roams and captured ones side by side, and what each has alone.

    ``commands`` (on the capture's clock): capture, sta, bssid, line, cmd_us,
    total_us. ``roams``: capture, sta, ap, assoc_num, auth_us, assoc_us. A
    command meets an authentication, the time of its connection an association
    without one, of the same AP within 250 ms.
    """
    keys = ["capture", "sta", "ap"]
    cmd = settled(commands.withColumnRenamed("bssid", "ap"), "commands")
    own = cmd.select(*keys, F.col("cmd_us").alias("left_us"), F.col("line").alias("left_id"), F.array("cmd_us", F.col("cmd_us") + F.col("total_us")).alias("at"))
    late = F.col("auth_us").isNull()
    air = roams.select(*keys, F.when(late, 1).otherwise(0).alias("kind"), F.when(late, F.col("assoc_us")).otherwise(F.col("auth_us")).alias("air_us"), F.col("assoc_num").alias("right_id"))
    pairs = settled(one_to_one(own, air, keys, LOG_US), "pairs")
    logs = cmd.select("capture", "sta", "ap", "line", "cmd_us", (F.col("total_us") / 1000).alias("sta_total_ms"))
    both = logs.join(pairs.select(F.col("left_id").alias("line"), F.col("right_id").alias("num"), F.col("far").alias("residual_us")), "line", "left")
    air = roams.join(pairs.select(F.col("right_id").alias("assoc_num")), "assoc_num", "left_anti")
    alone = air.select("capture", "sta", "ap", F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("cmd_us"), F.lit(None).cast("double").alias("sta_total_ms"), F.col("assoc_num").alias("num"), F.lit(None).cast("long").alias("residual_us"), F.lit("air_only").alias("side"))
    return both.withColumn("side", F.when(F.col("num").isNull(), "log_only").otherwise("both")).select(alone.columns).unionByName(alone).withColumnRenamed("num", "assoc_num")


def compared(found: DataFrame, own: DataFrame) -> DataFrame:
    """Where a result and the ledger differ; no rows if they agree.

    Both: sta, ap, assoc_num, at_us (the authentication's time, else the
    association's), is_slow, sta_total_ms. Roams of one station and AP meet
    within 50 ms, in the result's order.
    """
    one = found.select("sta", "ap", F.col("at_us").alias("left_us"), F.col("assoc_num").alias("left_id"), F.array("at_us").alias("at"))
    two = own.select("sta", "ap", F.lit(0).alias("kind"), F.col("at_us").alias("air_us"), F.col("assoc_num").alias("right_id"))
    pairs = settled(one_to_one(one, two, ["sta", "ap"], RESULT_US), "pairs")
    ours = own.select(F.col("assoc_num").alias("right_id"), F.col("is_slow").alias("own_slow"), F.col("sta_total_ms").alias("own_total"))
    both = found.withColumnRenamed("assoc_num", "left_id").join(pairs, "left_id").join(ours, "right_id")
    fields = F.array_compact(F.array(F.when(~F.col("is_slow").eqNullSafe(F.col("own_slow")), "is_slow"), F.when(~F.col("sta_total_ms").eqNullSafe(F.col("own_total")), "sta_total_ms")))
    shape = lambda df, kind, left, right, what: df.select(F.lit(kind).alias("kind"), "sta", "ap", "at_us", left.cast("long").alias("found_num"), right.cast("long").alias("own_num"), what.alias("fields"))
    none = F.lit(None)
    parts = (
        shape(both.withColumn("f", fields).where(F.size("f") > 0), "field_mismatch", F.col("left_id"), F.col("right_id"), F.array_join("f", "+")),
        shape(found.join(pairs, F.col("assoc_num") == F.col("left_id"), "left_anti"), "found_only", F.col("assoc_num"), none, F.lit("")),
        shape(own.join(pairs, F.col("assoc_num") == F.col("right_id"), "left_anti"), "own_only", none, F.col("assoc_num"), F.lit("")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def totals(roams: DataFrame, name: str) -> DataFrame:
    """Counts a result is first compared by."""
    one = lambda c: F.count(F.when(c, 1))
    return roams.agg(F.lit(name).alias("result"), F.count("*").alias("roams"), one(F.col("is_slow")).alias("slow"), one(F.col("slow_basis").isNotNull()).alias("decided"), one(F.col("slow_basis").isNull()).alias("unmeasured"), one(F.col("sta_total_ms").isNotNull()).alias("attached"))
