"""Several sniffers of one air: clock offsets, duplicates, comparison."""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.tables import settled
from framewright.operators.joins import SECOND, by_rank, islands, numbered, range_join, slices
from framewright.operators.stats import one_if, percent, second

# Duplicate window, least pairs of an offset, reach of the fallback.
WINDOW_US, LEAST_PAIRS, REACH_US = 50_000, 10, 5 * SECOND
#: Fields that make one copy of a frame more telling than another.
SCORED = ("ip_src", "arp_opcode", "icmp_type", "eapol_msgnr", "tcp_flags", "tcp_len")
#: Fields that a copy may fill in for its group's representative.
FILLED = ("ip_src", "ip_dst", "icmp_type", "icmp_seq", "icmp_ident", "arp_opcode", "tcp_len", "tcp_flags", "eapol_msgnr", "reason_code", "current_ap")
GENERIC = ("802.11", None)


def _middle(pairs: DataFrame) -> DataFrame:
    """Number, median and spread (by integer places) of each source's ``d``."""
    n = F.col("n")
    at = by_rank(pairs, ["source"], "d", {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)})
    return at.where(n >= LEAST_PAIRS).select("source", n.alias("pairs"), ((F.col("low") + F.col("high")) / 2).alias("offset_us"), F.when(n >= 4, F.col("q3") - F.col("q1")).otherwise(0).alias("iqr_us"))


def tsf_pairs(frames: DataFrame, reference: str = "w1") -> DataFrame:
    """Beacons of one (bssid, tsf) heard by the reference and another source.

    Keys that repeat within a source say nothing and are left out.
    """
    beacons = frames.where((F.col("subtype") == 8) & F.col("tsf").isNotNull()).groupBy("source", "bssid", "tsf").agg(F.count("*").alias("n"), F.min("epoch_us").alias("epoch_us")).where("n = 1")
    ref = beacons.where(F.col("source") == reference).select("bssid", "tsf", F.col("epoch_us").alias("ref_us"))
    return beacons.where(F.col("source") != reference).join(ref, ["bssid", "tsf"]).select("source", (F.col("ref_us") - F.col("epoch_us")).alias("d"))


def tsf_offset(frames: DataFrame, reference: str = "w1") -> DataFrame:
    """Clock offset of each source to the reference, from ten beacons on."""
    return _middle(tsf_pairs(frames, reference))


def _nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """One-to-one pairs, the nearest first; a frame is in one key's pairs."""
    used: set[tuple[str, str, int]] = set()
    out = []
    for r in rows.assign(a=rows["d"].abs()).sort_values(["a", "ref_num", "oth_num"]).itertuples(index=False):
        if (r.source, "r", r.ref_num) not in used and (r.source, "o", r.oth_num) not in used:
            used |= {(r.source, "r", r.ref_num), (r.source, "o", r.oth_num)}
            out.append((r.source, r.d))
    return pd.DataFrame(out, columns=["source", "d"])


def seq_offset(frames: DataFrame, reference: str = "w1") -> DataFrame:
    """Fallback offset from frames of one (ta, seq, subtype) within 5 s."""
    known = frames.where(F.col("seq").isNotNull() & F.col("ta").isNotNull())
    keys = ["ta", "seq", "subtype"]
    ref = known.where(F.col("source") == reference).select(*keys, F.col("epoch_us").alias("t"), F.col("number").alias("ref_num"))
    oth = known.where(F.col("source") != reference).select(*keys, "source", F.col("epoch_us").alias("oth_us"), F.col("number").alias("oth_num"))
    near = range_join(ref, oth, keys, "oth_us", -REACH_US, REACH_US).withColumn("d", F.col("t") - F.col("oth_us"))
    # Pairs of a key are cut by pauses, so that a number used all day is many small groups.
    runs = islands(near.withColumn("at", F.col("t")), [*keys, "source"], ["at", "ref_num", "oth_num"], 2 * REACH_US)
    found = slices(runs, [*keys, "source"], 16).applyInPandas(_nearest, "source string, d long")
    return _middle(found)


def aligned(frames: DataFrame, reference: str = "w1") -> DataFrame:
    """All sources on the reference's clock; unknown offsets change nothing.

    Offsets, a row a source, go to all frames; frames dealt by source would be
    one task a sniffer.
    """
    offsets = tsf_offset(frames, reference).select("source", F.round("offset_us").cast("long").alias("shift"))
    return frames.join(F.broadcast(offsets), "source", "left").withColumn("epoch_us", F.col("epoch_us") + F.coalesce("shift", F.lit(0))).select(*frames.columns)


def _score(r: tuple, at: dict[str, int]) -> int:
    return sum(r[at[c]] is not None for c in SCORED)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Representatives of runs of keys' frames, with their sources.

    A frame joins the latest group of its window that lacks its source, of one
    time the first. Groups wait by the sources they hold, the latest on top, so
    a frame looks at one of each and however many are open are all in reach.
    """
    names, keys = list(rows.columns), ["k1", "k2", "k3", "k4"]
    at = {c: k for k, c in enumerate(names)}
    table = rows.astype(object).where(rows.notna(), None).sort_values([*keys, "epoch_us", "source", "number"], kind="stable")
    same = [at[k] for k in keys]
    held = None
    waiting: dict[frozenset, list[tuple[int, int]]] = {}
    every: list[dict] = []
    for f in map(list, table.itertuples(index=False, name=None)):
        t, source, key = f[at["epoch_us"]], f[at["source"]], [f[k] for k in same]
        if key != held:
            waiting, held = {}, key
        tops = [(groups[0], has) for has, groups in waiting.items() if source not in has and groups and t + groups[0][0] <= WINDOW_US]
        if not tops:
            alone = frozenset((source,))
            heappush(waiting.setdefault(alone, []), (-t, len(every)))
            every.append({"rep": f, "sources": alone})
            continue
        place, has = min(tops)
        heappop(waiting[has])
        g = every[place[1]]
        g["sources"] = has | {source}
        heappush(waiting.setdefault(g["sources"], []), place)
        rep, other = g["rep"], f
        mine, theirs = _score(rep, at), _score(f, at)
        if theirs > mine or theirs == mine and t < rep[at["epoch_us"]]:
            rep, other = f, rep
        for c in FILLED:
            if rep[at[c]] is None:
                rep[at[c]] = other[at[c]]
        if rep[at["protocol"]] in GENERIC and other[at["protocol"]] not in GENERIC:
            rep[at["protocol"]] = other[at["protocol"]]
        g["rep"] = rep
    out = pd.DataFrame([g["rep"] for g in every], columns=names, dtype=object)
    return out.assign(sources=[",".join(sorted(g["sources"])) for g in every])


def dedup(frames: DataFrame) -> DataFrame:
    """One frame for copies that several sources heard within 50 ms.

    Copies agree on sender, sequence number, subtype and retry flag (without a
    number: on subtype, a peer and the flag). A group holds each source once
    and its window starts at its first frame. Runs of a key end at pauses
    beyond the window, after which no group can take a frame; a run of one
    source has nothing to merge and passes as it is, others are folded.
    """
    seq = F.col("seq").isNotNull()
    peer = F.when(seq, F.col("ta")).otherwise(F.coalesce("ta", "ra"))
    keyed = frames.withColumns({"k1": F.coalesce(peer, F.lit("")), "k2": F.coalesce("seq", F.lit(-1)), "k3": F.coalesce("subtype", F.lit(-1)), "k4": F.coalesce("retry", F.lit(False))})
    keys, columns = ["k1", "k2", "k3", "k4"], frames.columns
    runs = islands(keyed, keys, ["epoch_us", "source", "number"], WINDOW_US)
    by = Window.partitionBy(*keys, "island")
    told = settled(runs.withColumn("mixed", F.min("source").over(by) != F.max("source").over(by)), "runs")
    alone = told.where(~F.col("mixed")).select(*columns, F.col("source").alias("sources"))
    fields = T.StructType([*frames.schema.fields, T.StructField("sources", T.StringType())])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _merged(rows[[*columns, *keys]])[[*columns, "sources"]]

    return alone.unionByName(slices(told.where("mixed").drop("mixed"), keys, 16).applyInPandas(merge, fields))


def summary(merged: DataFrame) -> DataFrame:
    """What a merge came to: span, kept frames, duplicates, coverage."""
    heard = F.size(F.split("sources", ","))
    return merged.agg(F.min("epoch_us").alias("start_us"), F.max("epoch_us").alias("end_us"), F.count("*").alias("kept"), F.sum(heard - 1).cast("long").alias("duplicates"), one_if(heard > 1).alias("shared"), one_if(heard == 1).alias("alone"))


def coverage(merged: DataFrame) -> DataFrame:
    """Frames heard by each set of sources."""
    return merged.groupBy("sources").agg(F.count("*").alias("n"))


def sniffer_compare(frames: DataFrame) -> DataFrame:
    """Frames, retries and signal of each source and second."""
    return frames.groupBy("source", second().alias("sec")).agg(F.count("*").alias("total"), one_if(F.col("retry")).alias("retry"), percent(one_if(F.col("retry")), F.count("*")).alias("retry_pct"), F.round(F.avg("rssi"), 6).alias("avg_rssi"))


def renumbered(merged: DataFrame) -> DataFrame:
    """Frames numbered 1..n in order of time, the old number kept."""
    return numbered(merged).withColumns({"orig_number": F.col("number"), "number": F.col("rank").cast("long")}).drop("rank")
