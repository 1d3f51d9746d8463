"""Frames derived from the ``events`` table, to exercise the operators.

A deterministic, integer-only mapping; it claims nothing about what events
are. Time is compressed two-hundredfold so that seconds-wide windows hold
several frames. The same mapping is given as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tables import kept
from framewright.sources.frames import COLUMNS, SCHEMA

BASE_US = 1_704_067_200_000_000
SQUEEZE = 200
STATIONS, APS = 8, 3

#: (event type, slot, condition, {column: expression}); the expressions are
#: plain enough for both engines. Slots number the frames of an event.
KINDS: list[tuple[str, int, str, dict[str, str]]] = [
    ("view", 0, "k % 11 <> 0", {"subtype": "40", "protocol": "'ICMP'", "length": "98", "retry": "k % 13 = 0", "ta": "sta", "ra": "ap", "ip_src": "sta_ip", "ip_dst": "'10.0.1.1'", "icmp_type": "8", "icmp_seq": "ping", "seq": "ping % 4096", "mcs": "k % 8", "rssi": "-40 - k % 45"}),
    ("view", 1, "k % 5 <> 0", {"t": "t + v * 200", "subtype": "40", "protocol": "'ICMP'", "length": "98", "retry": "k % 17 = 0", "ta": "ap", "ra": "sta", "ip_src": "'10.0.1.1'", "ip_dst": "sta_ip", "icmp_type": "0", "icmp_seq": "ping", "seq": "(ping + 7) % 4096", "mcs": "k % 9", "rssi": "-35 - k % 30"}),
    ("view", 2, "k % 7 = 0", {"t": "t + 3000", "subtype": "40", "protocol": "'ICMP'", "length": "98", "retry": "true", "ta": "sta", "ra": "ap", "ip_src": "sta_ip", "ip_dst": "'10.0.1.1'", "icmp_type": "8", "icmp_seq": "ping", "seq": "ping % 4096", "mcs": "k % 4", "rssi": "-45 - k % 45"}),
    ("signup", 0, "k % 6 <> 0", {"subtype": "11", "ta": "sta", "ra": "ap", "seq": "ping % 4096", "rssi": "-50 - k % 20"}),
    ("signup", 1, "k % 8 <> 0", {"t": "t + 2000", "subtype": "11", "ta": "ap", "ra": "sta", "seq": "(ping + 1) % 4096", "rssi": "-48 - k % 20"}),
    ("signup", 2, "true", {"t": "t + 5000 + 2 * v", "subtype": "2", "ta": "sta", "ra": "ap", "current_ap": "old_ap", "seq": "(ping + 2) % 4096", "rssi": "-50 - k % 20"}),
    *[("signup", 2 + m, f"(k + {m}) % 9 <> 0", {"t": f"t + 17000 + 2 * v + {m} * (v * k % 30000)", "subtype": "40", "protocol": "'EAPOL'", "length": "160", "retry": f"k % {10 + m} = 0", "ta": "ap" if m % 2 else "sta", "ra": "sta" if m % 2 else "ap", "eapol_msgnr": str(m), "seq": f"(ping + {2 + m}) % 4096", "rssi": "-50 - k % 20"}) for m in (1, 2, 3, 4)],
    ("error", 0, "k % 4 = 0", {"subtype": "12", "ta": "ap", "ra": "sta", "reason_code": "k % 9", "seq": "ping % 4096"}),
    ("error", 0, "k % 4 = 1", {"subtype": "10", "ta": "sta", "ra": "ap", "reason_code": "8", "seq": "ping % 4096"}),
    ("error", 0, "k % 4 = 2", {"subtype": "4", "ta": "sta", "ra": "'ff:ff:ff:ff:ff:ff'", "bssid": "'ff:ff:ff:ff:ff:ff'", "seq": "ping % 4096", "rssi": "-60 - k % 20"}),
    ("error", 0, "k % 4 = 3", {"subtype": "32", "protocol": "'ARP'", "length": "60", "ta": "sta", "ra": "ap", "arp_opcode": "1 + k % 2", "retry": "k % 3 = 0", "seq": "ping % 4096", "rssi": "-60 - k % 20", "mcs": "k % 5"}),
    ("click", 0, "true", {"subtype": "40", "protocol": "'TCP'", "length": "200 + v % 1300", "retry": "k % 5 = 0 or k % 7 < 3 and k > 60", "mcs": "k % 12", "mcs_phy": "case k % 4 when 0 then 'HT' when 1 then 'VHT' when 2 then 'HE' else 'Legacy' end", "nss": "1 + k % 2", "data_rate": "case when k % 4 = 3 then cast(6 * (1 + k % 9) as string) end", "ta": "sta", "ra": "ap", "tcp_len": "case when k % 9 = 0 then 0 else 160 + v % 1300 end", "tcp_flags": "'0x10'", "ip_src": "sta_ip", "ip_dst": "'10.0.2.9'", "seq": "ping % 4096", "rssi": "-40 - k % 50"}),
    ("purchase", 0, "true", {"subtype": "8", "ta": "ap", "ra": "'ff:ff:ff:ff:ff:ff'", "length": "220", "channel_freq": "case kap when 0 then 2412 when 1 then 5180 else 5955 end", "tsf": "t - 1704067200000000 + 5000000", "seq": "ping % 4096", "rssi": "-30 - k % 40"}),
]
DEFAULTS = {"t": "t", "subtype": "null", "protocol": "'802.11'", "length": "64", "retry": "false", "bssid": "ap"}


def _cells(slot: int, fields: dict[str, str], kinds: dict[str, str]) -> dict[str, str]:
    own = DEFAULTS | {"icmp_ident": "'1'" if "icmp_type" in fields else "null"} | fields
    own |= {"number": f"event_id * 10 + {slot}", "epoch_us": own["t"], "source": "'w1'"}
    return {c: f"cast({own.get(c, 'null')} as {kinds[c]})" for c in COLUMNS}


def frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived frames of one sniffer, as a table written once.

    Queries then read the columns and rows they need from Parquet, as they
    would of a decoded capture.
    """
    return kept(spark, ("frames", sf_dir), lambda: derived(spark, sf_dir), f"{sf_dir}/events.parquet")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of events to frames."""
    shaped = _shaped(spark, sf_dir)
    kinds = _kinds({"long": "bigint"})
    parts = None
    for event in dict.fromkeys(e for e, *_ in KINDS):  # one scan for each type of event
        slots = [f"case when {w} then named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {x}' for c, x in _cells(n, fields, kinds).items())}) end" for e, n, w, fields in KINDS if e == event]
        part = shaped.where(F.col("event_type") == event).select(F.expr(f"inline(filter(array({', '.join(slots)}), x -> x is not null))"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def second_sniffer(frames: DataFrame) -> DataFrame:
    """What a second sniffer, 2.5 s ahead, would have of three in four frames."""
    shift = F.lit(2_500_000) + F.when(F.col("subtype") == 8, 0).otherwise(F.expr("number div 10") % 5 * 1000)
    seen = frames.where((F.expr("number div 10") % 4 != 3))
    return seen.withColumns({"epoch_us": F.col("epoch_us") + shift, "source": F.lit("w2"), "rssi": F.col("rssi") - 3, "ip_src": F.when(F.expr("number div 10") % 3 != 0, F.col("ip_src"))})


def _kinds(names: dict[str, str]) -> dict[str, str]:
    return {c: names.get(kind, kind) for c, kind in (x.split() for x in SCHEMA.split(", "))}


def sql() -> str:
    """CTEs ``shaped`` and ``frames`` for DuckDB."""
    kinds = _kinds({"int": "integer", "string": "varchar", "long": "bigint"})
    each = [f"SELECT {', '.join(f'{x} AS {c}' for c, x in _cells(n, f, kinds).items())} FROM shaped WHERE event_type = '{e}' AND {w}" for e, n, w, f in KINDS]
    union = "\nUNION ALL\n".join(each).replace("as string", "as varchar")
    return f"""shaped AS (
SELECT *, k % {APS} AS kap, '02:00:00:00:00:0' || u AS sta, '10.0.0.' || (u + 10) AS sta_ip, '0a:00:00:00:00:0' || (k % {APS}) AS ap, '0a:00:00:00:00:0' || ((k + 1) % {APS}) AS old_ap
FROM (SELECT event_id, event_type, {BASE_US} + (epoch_us(ts) - {BASE_US}) // {SQUEEZE} AS t, cast(json_extract_string(props, '$.k') AS bigint) AS k,
  cast(floor(value * 100 + 0.5) AS bigint) AS v, user_id % {STATIONS} AS u, event_id % 60000 AS ping FROM events)
), frames AS (
{union}
)"""


def sql_two() -> str:
    """As :func:`sql`, and ``heard``: the frames of two sniffers."""
    cells = {"epoch_us": "epoch_us + 2500000 + CASE WHEN subtype = 8 THEN 0 ELSE number // 10 % 5 * 1000 END", "source": "'w2'", "rssi": "rssi - 3", "ip_src": "CASE WHEN number // 10 % 3 <> 0 THEN ip_src END"}
    return sql() + f""", heard AS (
SELECT {", ".join(COLUMNS)} FROM frames UNION ALL
SELECT {", ".join(f"{cells[c]} AS {c}" if c in cells else c for c in COLUMNS)} FROM frames WHERE number // 10 % 4 <> 3
)"""



#: Station log events: (event type, condition, time, event, has the AP).
LOGGED = [
    ("signup", "true", "t - 20000", "roam", True),
    ("signup", "k % 7 <> 0", "t + 60000 + v * 3 % 400000", "connected", True),
    ("signup", "k % 7 = 0", "t + 50000", "failed", False),
    ("click", "k % 10 = 0", "t", "scan_start", False),
    ("click", "k % 20 = 0", "t + 300000", "scan_done", False),
    ("click", "k % 20 = 10 and k % 3 = 0", "t + 250000", "scan_done", False),
    ("view", "k % 6 = 0", "t", "condition", False),
    ("view", "k % 6 = 1", "t", "candidate", True),
    ("view", "k % 6 = 2", "t", "decision", True),
    ("view", "k % 30 = 3", "t", "skip", False),
]


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr(f"{BASE_US} + (unix_micros(cast(ts as timestamp)) - {BASE_US}) div {SQUEEZE}")
    k, v = F.get_json_object("props", "$.k").cast("long"), F.floor(F.col("value") * 100 + 0.5).cast("long")
    shaped = events.select("event_id", "event_type", t.alias("t"), k.alias("k"), v.alias("v"), (F.col("user_id") % STATIONS).alias("u"), (F.col("event_id") % 60_000).alias("ping"))
    mac = lambda n: F.concat(F.lit("0a:00:00:00:00:0"), (n % APS).cast("string"))
    return shaped.select(
        "*",
        (F.col("k") % APS).alias("kap"),
        F.concat(F.lit("02:00:00:00:00:0"), F.col("u").cast("string")).alias("sta"),
        F.concat(F.lit("10.0.0."), (F.col("u") + 10).cast("string")).alias("sta_ip"),
        mac(F.col("k")).alias("ap"),
        mac(F.col("k") + 1).alias("old_ap"),
    )


def station_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station log events: sta, epoch_us, event, bssid, from_bssid (of
    decisions), line (a total order)."""
    shaped, parts = _shaped(spark, sf_dir), None
    for n, (e, where, at, event, ap) in enumerate(LOGGED):
        part = shaped.where(f"event_type = '{e}' and {where}").select("sta", F.expr(at).alias("epoch_us"), F.lit(event).alias("event"), (F.col("ap") if ap else F.lit(None).cast("string")).alias("bssid"), (F.col("old_ap") if event == "decision" else F.lit(None).cast("string")).alias("from_bssid"), (F.col("event_id") * 10 + n).alias("line"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def ntp_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time server replies: frame_no, arrival_us, org_us, dst."""
    own = _shaped(spark, sf_dir).where("event_type = 'purchase'")
    return own.select(F.col("event_id").alias("frame_no"), F.col("t").alias("arrival_us"), F.expr("t + 120000 + ping div 10 + v % 4000").alias("org_us"), F.col("sta_ip").alias("dst"))


def sync_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock contacts of one station's log: line_no, ts_us."""
    own = _shaped(spark, sf_dir).where("event_type = 'purchase' and k % 3 = 0 and u < 4")
    return own.select(F.col("event_id").alias("line_no"), F.expr("t + 130000 + v % 900").alias("ts_us"))


def sql_logs() -> str:
    """As :func:`sql`, and ``logged``, ``ntp`` and ``syncs``."""
    each = [f"SELECT sta, {at} AS epoch_us, '{event}' AS event, {'ap' if ap else 'NULL'} AS bssid, {'old_ap' if event == 'decision' else 'NULL'} AS from_bssid, event_id * 10 + {n} AS line FROM shaped WHERE event_type = '{e}' AND {where}" for n, (e, where, at, event, ap) in enumerate(LOGGED)]
    union = "\nUNION ALL\n".join(each)
    return sql() + f""", logged AS (
{union}
), ntp AS (
SELECT event_id AS frame_no, t AS arrival_us, t + 120000 + ping // 10 + v % 4000 AS org_us, sta_ip AS dst FROM shaped WHERE event_type = 'purchase'
), syncs AS (
SELECT event_id AS line_no, t + 130000 + v % 900 AS ts_us FROM shaped WHERE event_type = 'purchase' AND k % 3 = 0 AND u < 4
)"""


#: Logs of units whose station and clock aren't known: a unit's clock is so far
#: behind the capture's, by station; some know an address, one of them another's.
UNIT_BEHIND_US = (0, -2_744_000, -187_110_000, 32_401_300_000, 0, 5_250_000, -612_000_000, 411_000)
UNIT_IP = "case u when 0 then '10.0.0.10' when 3 then '10.0.0.10' when 5 then '10.0.0.15' when 7 then '10.0.0.99' end"
#: Hours of the derived time are recordings of their own.
RECORDING_US = 3_600_000_000


def recording(at: Column) -> Column:
    """The recording a time belongs to."""
    return F.concat(F.lit("h"), F.floor((at - BASE_US) / RECORDING_US).cast("string"))


def unit_logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station log events by recording and unit, on each unit's own clock:
    capture, name, ord, ip, epoch_us, event, bssid, line."""
    u = F.right("sta", F.lit(1)).cast("int")
    own = station_log_from_events(spark, sf_dir).withColumn("u", u).withColumn("capture", recording(F.col("epoch_us")))
    behind = F.element_at(F.array(*[F.lit(x).cast("long") for x in UNIT_BEHIND_US]), F.col("u") + 1)
    return own.select("capture", F.concat(F.lit("unit-"), (7 - F.col("u")).cast("string")).alias("name"), (7 - F.col("u")).alias("ord"), F.expr(UNIT_IP).alias("ip"), (F.col("epoch_us") - behind).alias("epoch_us"), "event", "bssid", "line")


def sql_units() -> str:
    """As :func:`sql_logs`, and ``unit_rows`` and ``units``."""
    return sql_logs() + f""", unit_rows AS (
SELECT 'h' || ((epoch_us - {BASE_US}) // {RECORDING_US}) AS capture, 'unit-' || (7 - u) AS name, 7 - u AS ord, {UNIT_IP} AS ip, epoch_us - {list(UNIT_BEHIND_US)}[u + 1] AS epoch_us, event, bssid, line
FROM (SELECT *, cast(right(sta, 1) AS integer) AS u FROM logged)
), units AS (
SELECT DISTINCT capture, name, ord, ip FROM unit_rows
)"""
