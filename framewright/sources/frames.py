"""The frame table: its schema, and frames from the decoder's text output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import frames as P

SCHEMA = (
    "number long, epoch_us long, source string, subtype int, protocol string, length int, retry boolean, "
    "mcs int, mcs_phy string, nss int, data_rate string, rssi int, ta string, ra string, bssid string, current_ap string, "
    "ip_src string, ip_dst string, icmp_type int, icmp_seq int, icmp_ident string, arp_opcode int, tcp_len int, tcp_flags string, "
    "seq int, reason_code int, channel_freq int, eapol_msgnr int, tsf long"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]

# The decoder's 34 fields in their order.
RAW = (
    "number", "epoch", "timestamp", "retry", "subtype", "protocol", "length", "ht_mcs", "rssi", "ta", "ra", "bssid",
    "ip_src", "ip_dst", "icmp_type", "arp_opcode", "tcp_len", "tcp_flags", "seq", "icmp_seq",
    "ht_mcs_2", "vht_mcs", "eht_mcs", "he_mcs", "data_rate", "icmp_ident", "reason_code", "current_ap", "channel_freq",
    "eapol_msgnr", "tsf", "vht_nss", "he_nss", "eht_nss",
)
LEAST_FIELDS = 7


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def typed(raw: DataFrame, source: str = "w1") -> DataFrame:
    """Frames from a table of raw text fields; absent fields are null.

    The rate comes from the first field present of HT, VHT, EHT, HE; without
    any the format is Legacy. Streams come from the field of that format only.
    Rows without a number, a time or (where one is given) a whole length are
    dropped.
    """
    have = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RAW])
    ht = F.coalesce(_text("ht_mcs"), _text("ht_mcs_2"))
    kinds = [("HT", ht), ("VHT", _text("vht_mcs")), ("EHT", _text("eht_mcs")), ("HE", _text("he_mcs"))]
    phy, mcs = F.lit("Legacy"), F.lit(None).cast("string")
    for name, c in reversed(kinds):
        phy, mcs = F.when(c.isNotNull(), name).otherwise(phy), F.coalesce(c, mcs)
    rate = P.number(mcs)
    own = F.when(phy == "VHT", P.number(F.col("vht_nss"))).when(phy == "HE", P.number(F.col("he_nss"))).when(phy == "EHT", P.number(F.col("eht_nss")))
    nss = F.nullif(F.when(phy == "HT", P.ht_streams(rate)).otherwise(own), F.lit(0))
    mac = lambda c: F.lower(P.first_token(F.col(c)))
    ints = {c: P.number(F.col(c)) for c in ("subtype", "rssi", "icmp_type", "icmp_seq", "arp_opcode", "tcp_len", "seq", "reason_code", "channel_freq", "eapol_msgnr")}
    found = {
        "number": F.col("number").try_cast("long"),
        "epoch_us": F.round(F.col("epoch").try_cast("decimal(20,6)") * 1_000_000).cast("long"),
        "source": F.lit(source),
        "protocol": _text("protocol"),
        "length": F.coalesce(P.number(F.col("length")), F.lit(0)),
        "retry": P.flag(F.col("retry")),
        "mcs": rate,
        "mcs_phy": phy,
        "nss": nss,
        "data_rate": P.first_token(F.col("data_rate")),
        **{c: mac(c) for c in ("ta", "ra", "bssid", "current_ap")},
        **{c: P.first_token(F.col(c)) for c in ("ip_src", "ip_dst", "icmp_ident", "tcp_flags")},
        "tsf": P.first_token(F.col("tsf")).try_cast("long"),
        **ints,
    }
    sized = have.where(_text("length").isNull() | F.trim("length").try_cast("int").isNotNull())
    return sized.select(*[found[c].alias(c) for c in COLUMNS]).where(F.col("number").isNotNull() & F.col("epoch_us").isNotNull())


def parsed(lines: DataFrame, source: str = "w1", fields: Sequence[str] = RAW) -> DataFrame:
    """Frames from decoder lines (column value); short lines are dropped.

    ``fields`` names the columns of a decoder that lacks some of :data:`RAW`;
    those are null.
    """
    cells = F.split(F.btrim("value", F.lit(" \t\r\n")), "\t")
    cut = lines.select(cells.alias("c")).where(F.size("c") >= LEAST_FIELDS)
    return typed(cut.select(*[F.try_element_at("c", F.lit(k + 1)).alias(n) for k, n in enumerate(fields)]), source)


def read_decoder_text(spark: SparkSession, path: str, source: str = "w1", fields: Sequence[str] = RAW) -> DataFrame:
    """Frames from files of tab-separated decoder output."""
    return parsed(spark.read.text(path), source, fields)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames from Parquet; columns that a file lacks are null."""
    have = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(SCHEMA)}
    return have.select(*[(F.col(c) if c in have.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def selected(frames: DataFrame, start_us: int | None = None, end_us: int | None = None, macs: list[str] = (), ips: list[str] = ()) -> DataFrame:
    """Half-open time window, any of the MACs, any of the addresses."""
    if start_us is not None:
        frames = frames.where(F.col("epoch_us") >= start_us)
    if end_us is not None:
        frames = frames.where(F.col("epoch_us") < end_us)
    if macs:
        frames = frames.where(F.col("ta").isin(*macs) | F.col("ra").isin(*macs))
    if ips:
        frames = frames.where(F.col("ip_src").isin(*ips) | F.col("ip_dst").isin(*ips))
    return frames


def union_captures(pieces: list[DataFrame]) -> DataFrame:
    """Pieces of a rotated capture in order of time; nothing is deduplicated.

    Frames are numbered anew where their numbers would clash, by whoever needs
    unique ones (``merge.renumbered``).
    """
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.orderBy("epoch_us", "source", "number")
