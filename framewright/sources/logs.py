"""Station logs, generic logs, wired results and clock records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How the lines of station logs are written.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+(\S+?)\[(\w+)\]\s*(.*)$"
IFACE = r"^([A-Za-z0-9_.-]+):\s*(.*)$"
MAC = r"((?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2})"
COMMAND = rf"Control interface command 'ROAM {MAC}'"
CONNECTED = rf"CTRL-EVENT-CONNECTED - Connection to {MAC}"
STATE = r"State: ([A-Z_0-9]+) -> ([A-Z_0-9]+)"
FAIL_STATES = ("DISCONNECTED", "SCANNING", "INACTIVE")
TIMED_OUT = r"Event AUTH_TIMED_OUT \(\d+\) received"
SCAN_START = r"wlan:\s*\S+\s+START SCAN"
SCAN_DONE = r"wlan:\s*SCAN COMPLETED: scanned AP count=(\d+)"
ADDRESS = r"bridge:\s*wlan IPv4 updated\s*=\s*(\d+\.\d+\.\d+\.\d+)"
DECISION = rf"Roaming:\s*{MAC}\s*→\s*{MAC}"
CANDIDATE = rf"Roam candidate:\s*{MAC},\s*rssi=(-?\d+)dB(?:\s*\(diff=(-?\d+)dB\))?.*?reason=([^,]+),\s*score=([\d.]+)"
CONDITION = r"roaming condition:\s*(-?\d+)\s*<\s*(-?\d+)\s*\(base=(-?\d+),\s*trend=(\w+)\)"
SKIP = r"Roam skipped|No suitable roam candidate"
#: Files of one station's set, and what each one's absence leaves unknown.
STATION_FILES = {"wpa.log": "no wpa.log: whole roam times are unknown", "kern.log": "no kern.log: scan times and the station's address are unknown", "logger.log": "no logger.log: reasons of roams are unknown"}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
# The header of a wired result file (full-width letters), and the
# words that make a line of a foreign log worth showing.
HEADER = ("結果", "日時", "対象", "ＩＰアドレス", "ステータス", "備考")
KEYWORDS = (
    "ROAM", "roam", "AUTH", "auth", "ASSOC", "assoc", "EAPOL", "eapol", "DISCONNECT", "disconnect", "SCAN", "scan",
    "CONNECT", "connect", "carrier", "link", "signal", "rssi", "RSSI", "4-Way", "4way", "handshake", "deauth", "DEAUTH",
)
#: Columns of a wired result file.
EXPING = ("result", "time", "target", "ip", "status", "remark")


def micros(text: Column, pattern: str) -> Column:
    """Microseconds of a time text in the session's zone; null if malformed."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit(pattern)))


def station_lines(lines: DataFrame) -> DataFrame:
    """Parsed station log lines (column value); others are skipped.

    Columns beside ``value`` stay. The interface is a word and a colon before
    the message; ``mono`` is the kernel's own clock, in seconds.
    """
    cell = lambda k: F.regexp_extract("value", LINE, k)
    head = lines.where(F.col("value").rlike(LINE)).withColumns({"epoch_us": micros(cell(1), "yyyy-MM-dd HH:mm:ss.SSS"), "proc": cell(2), "level": cell(3), "rest": cell(4)})
    iface = F.col("rest").rlike(IFACE)
    msg = F.when(iface, F.regexp_extract("rest", IFACE, 2)).otherwise(F.col("rest"))
    found = head.where(F.col("epoch_us").isNotNull()).withColumns({"iface": F.when(iface, F.regexp_extract("rest", IFACE, 1)), "msg": msg})
    return found.withColumn("mono", F.regexp_extract("msg", r"\[(\d+\.\d+)\]", 1).try_cast("double")).drop("rest", "value")


def read_station_log(spark: SparkSession, path: str) -> DataFrame:
    """Station log lines of files, numbered in order as ``line``.

    Numbers rise within a file; they are not consecutive.
    """
    return station_lines(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def station_events(lines: DataFrame) -> DataFrame:
    """Events of station log lines: ``event`` and what it says.

    roam, connected: bssid. failed: a state no roam passes through, or a
    timeout. associating: the state the procedure starts with. scan_start,
    scan_done: ap_count. address: ip. condition: trigger_rssi, trigger_th,
    trend. candidate: bssid, rssi, reason, score. decision: from_bssid, bssid.
    skip: what was considered is void.
    """
    m = F.col("msg")
    state = F.regexp_extract(m, STATE, 2)
    kind = (
        F.when(m.rlike(COMMAND), "roam")
        .when(state.isin(*FAIL_STATES) | m.rlike(TIMED_OUT), "failed")
        .when(state == "AUTHENTICATING", "associating")
        .when(m.rlike(CONNECTED), "connected")
        .when(m.rlike(SCAN_START), "scan_start")
        .when(m.rlike(SCAN_DONE), "scan_done")
        .when(m.rlike(ADDRESS), "address")
        .when(m.rlike(CONDITION), "condition")
        .when(m.rlike(CANDIDATE), "candidate")
        .when(m.rlike(SKIP), "skip")
        .when(m.rlike(DECISION), "decision")
    )
    mac = lambda pattern, k=1: F.lower(F.regexp_extract(m, pattern, k))
    of = lambda event, value: F.when(F.col("event") == event, value)
    number = lambda pattern, k, to="int": F.regexp_extract(m, pattern, k).try_cast(to)
    found = lines.withColumn("event", kind).where(F.col("event").isNotNull())
    return found.withColumns(
        {
            "bssid": F.coalesce(of("roam", mac(COMMAND)), of("connected", mac(CONNECTED)), of("candidate", mac(CANDIDATE)), of("decision", mac(DECISION, 2))),
            "from_bssid": of("decision", mac(DECISION)),
            "ap_count": of("scan_done", number(SCAN_DONE, 1)),
            "ip": of("address", F.regexp_extract(m, ADDRESS, 1)),
            "rssi": of("candidate", number(CANDIDATE, 2)),
            "reason": of("candidate", F.trim(F.regexp_extract(m, CANDIDATE, 4))),
            "score": of("candidate", number(CANDIDATE, 5, "double")),
            "trigger_rssi": of("condition", number(CONDITION, 1)),
            "trigger_th": of("condition", number(CONDITION, 2)),
            "trend": of("condition", F.regexp_extract(m, CONDITION, 4)),
        }
    )


def station_address(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each log's own address: the commonest one it was given, first seen first.

    The unset address doesn't count. ``addresses`` tells how many there were.
    """
    seen = events.where("event = 'address' and ip <> '0.0.0.0'").groupBy(*keys, "ip").agg(F.count("*").alias("n"), F.min(F.struct("epoch_us", "line")).alias("first"))
    best = F.max_by("ip", F.struct("n", -F.col("first.epoch_us"), -F.col("first.line")))
    return seen.groupBy(*keys).agg(best.alias("sta_ip"), F.count("*").alias("addresses"))


def read_station_set(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Events of one station's log files, and warnings of files that lack."""
    unknown = set(files) - set(STATION_FILES)
    if unknown:
        raise ValueError(f"no station log is called {', '.join(sorted(unknown))}")
    warnings = [text for name, text in STATION_FILES.items() if name not in files]
    parts = [read_station_log(spark, path).withColumn("file", F.lit(name)) for name, path in files.items()]
    if not parts:
        parts = [station_lines(spark.createDataFrame([], "value string, line long, file string"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return station_events(whole), warnings


def generic_lines(lines: DataFrame, year: int = 2026) -> DataFrame:
    """Times of lines in any of four formats; the first that fits counts."""
    v = F.col("value")
    syslog = F.regexp_extract(v, r"^([A-Z][a-z]{2})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2})", 0)
    parts = F.split(F.regexp_replace(syslog, r"\s+", " "), " ")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), parts[0])
    stamped = F.when(syslog != "", F.format_string(f"{year}-%02d-%02d %s", month.cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int"), F.try_element_at(parts, F.lit(3))))
    epoch = F.regexp_extract(v, r"^(\d{10}(?:\.\d+)?)\b", 1).try_cast("decimal(20,6)")
    iso = F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    time = F.regexp_extract(v, r"^(\d{2}:\d{2}:\d{2})", 1)
    found = F.coalesce((epoch * 1_000_000).cast("long"), micros(stamped, "yyyy-MM-dd HH:mm:ss"), micros(F.replace(iso, F.lit("T"), F.lit(" ")), "yyyy-MM-dd HH:mm:ss"), F.when(time != "", micros(F.concat(F.lit("1970-01-01 "), time), "yyyy-MM-dd HH:mm:ss")))
    return lines.select(found.alias("epoch_us"), v.alias("text")).where(F.col("epoch_us").isNotNull())


def merged_logs(lines: DataFrame, keywords: Sequence[str] = KEYWORDS, limit: int = 100) -> DataFrame:
    """The first lines in time that hold one of the keywords, case and all."""
    found = generic_lines(lines)
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.col("text").contains(word)
    return found.where(hit).orderBy("epoch_us", "text").limit(limit)


def ntp_micros(text: Column) -> Column:
    """Microseconds of times like ``Jul 21, 2026 05:57:35.004315599 UTC``.

    Digits beyond microseconds are cut; unset clocks (1900) are null.
    """
    pattern = r"^([A-Z][a-z]{2})\s+(\d{1,2}), (\d{4}) (\d{2}:\d{2}:\d{2})\.(\d{6})\d* UTC$"
    cell = lambda k: F.regexp_extract(text, pattern, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), cell(1)).cast("int")
    stamp = F.try_to_timestamp(F.format_string("%s-%02d-%02d %s.%s+0000", cell(3), month, cell(2).try_cast("int"), cell(4), cell(5)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSZ"))
    return F.when(text.rlike(pattern) & (cell(3) != "1900"), F.unix_micros(stamp))


def ntp_responses(raw: DataFrame) -> DataFrame:
    """Server replies with both clocks set: arrival_us, org_us, xmt_us."""
    return raw.select("frame_no", "arrival_us", "src", "dst", ntp_micros(F.col("org")).alias("org_us"), ntp_micros(F.col("xmt")).alias("xmt_us")).where("org_us is not null and xmt_us is not null")


def sync_events(lines: DataFrame) -> DataFrame:
    """Lines that tell of a contact with the time server."""
    return generic_lines(lines).where(F.col("text").contains("Contacted time server"))


def shifted_lines(lines: DataFrame, delta_us: int) -> DataFrame:
    """Lines whose leading time moves by a delta, its digits kept.

    Times without a fraction round to the nearest second; digits beyond six
    stay; a line without a time is unchanged.
    """
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?"
    whole, fraction = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    digits = F.length(fraction)
    base = micros(whole, "yyyy-MM-dd HH:mm:ss") + F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long"), F.lit(0))
    moved = base + delta_us
    rounded = F.when(digits == 0, F.floor((moved + 500_000) / 1_000_000) * 1_000_000).otherwise(moved)
    text = F.date_format(F.timestamp_micros(rounded), "yyyy-MM-dd HH:mm:ss")
    tail = F.lpad(F.pmod(rounded, F.lit(1_000_000)).cast("string"), 6, "0")
    shown = F.when(digits == 0, text).otherwise(F.concat(text, F.lit("."), F.left(tail, F.least(digits, F.lit(6))), F.substring(fraction, 7, 9)))
    rest = F.substring(F.col("value"), F.length(F.regexp_extract("value", pattern, 0)) + 1, F.length("value"))
    return lines.select(F.when(base.isNotNull() & (whole != ""), F.concat(shown, rest)).otherwise(F.col("value")).alias("value"))


def read_exping(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a wired result file, whose header must be :data:`HEADER`."""
    raw = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8")
    found = [c.lstrip("\ufeff").strip('"') for c in raw.columns]
    if found != list(HEADER):
        raise ValueError(f"the header {HEADER} is expected, not {found}")
    return raw.toDF(*EXPING)


def write_exping(rows: DataFrame, path: str) -> None:
    """Result lines as quoted CSV files; columns as :func:`read_exping` names them.

    Every field is quoted and lines end in CR and LF. Each file of the folder
    has the header, so that each can be read alone.
    """
    named = rows.select(*[F.col(c).cast("string").alias(h) for c, h in zip(EXPING, HEADER, strict=True)])
    named.write.csv(path, header=True, quoteAll=True, encoding="UTF-8", lineSep="\r\n", emptyValue="", nullValue="")
