"""Operators as queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import thresholds
from framewright.functions.tables import kept, settled, shared_dir
from framewright.operators import binding, devices, diagnosis, issues, merge, ping, roaming, signals, stations, stats, timesync, verifier, wired
from framewright.operators.joins import dealt
from framewright.sources import adapter, capture


def _frames(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of an operator over one sniffer's frames."""
    return lambda spark, sf_dir: operator(adapter.frames_from_events(spark, sf_dir))


def _both(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of an operator over two sniffers' frames."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = adapter.frames_from_events(spark, sf_dir)
        return operator(one.unionByName(adapter.second_sniffer(one)))

    return query


def _log(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of an operator over station logs."""
    return lambda spark, sf_dir: operator(adapter.station_log_from_events(spark, sf_dir))


def _ntp(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of an operator over time server replies."""
    return lambda spark, sf_dir: operator(adapter.ntp_from_events(spark, sf_dir))


def _wired_pairs(frames: DataFrame) -> DataFrame:
    return wired.exchanges(wired.packets(frames))


def _wired_trailing(frames: DataFrame) -> DataFrame:
    rows = wired.of_sender(wired.packets(frames))
    return wired.without_trailing_run(wired.exchanges(rows)).select("host", "target", "number", "epoch_us", "rtt_us")


def _exping(frames: DataFrame) -> DataFrame:
    rows = wired.of_sender(wired.packets(frames))
    return wired.exping_rows(wired.without_tail(wired.exchanges(rows), rows))


def _merged(frames: DataFrame) -> DataFrame:
    return merge.dedup(merge.aligned(frames))


def _once(tag: str, build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A step that several queries begin with, worked out once a table."""
    return lambda spark, sf_dir: kept(spark, (tag, sf_dir), lambda: build(spark, sf_dir), f"{sf_dir}/events.parquet")


#: Roam commands of units' logs, on their own clocks, and what ended them.
_unit_roams = _once("unit-roams", lambda spark, sf_dir: stations.wpa_episodes(adapter.unit_logs_from_events(spark, sf_dir), ("capture", "name"), ("line",)))


#: Captured roams with their recording.
_recorded = _once("recorded", lambda spark, sf_dir: roaming.pairing(adapter.frames_from_events(spark, sf_dir)).withColumn("air_us", F.coalesce("auth_us", "assoc_us")).withColumn("capture", adapter.recording(F.col("air_us"))))


def _clock_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.clock_scores(_unit_roams(spark, sf_dir).where("ok").select("capture", "name", "line", "cmd_us"), _recorded(spark, sf_dir).select("capture", "sta", "air_us"))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = adapter.unit_logs_from_events(spark, sf_dir).select("capture", "name", "ord", "ip").distinct()
    frames = adapter.frames_from_events(spark, sf_dir)
    return binding.bound(units, binding.addresses(frames.withColumn("capture", adapter.recording(F.col("epoch_us")))), _clock_scores(spark, sf_dir))


def _rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = _unit_roams(spark, sf_dir).where("ok").select("capture", "name", F.col("target").alias("ap"), "line", "cmd_us", (F.col("cmd_us") + F.col("total_us")).alias("connected_us"))
    return binding.rank_scores(commands, _recorded(spark, sf_dir).select("capture", "sta", "ap", "assoc_num", "auth_us", "assoc_us"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.assigned(_rank_scores(spark, sf_dir))


#: Successful roams of bound units, on the capture's clock.
_on_clock = _once("on-clock", lambda spark, sf_dir: binding.on_capture_clock(_unit_roams(spark, sf_dir), _bound(spark, sf_dir)))


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = settled(binding.on_capture_clock(_unit_roams(spark, sf_dir), _assigned(spark, sf_dir)), "commands")
    found = verifier.ledger(adapter.frames_from_events(spark, sf_dir))
    return verifier.correlated(commands, found.withColumn("capture", adapter.recording(F.coalesce("auth_us", "assoc_us"))))


def _both_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The roams with the logs' totals as the library and as the ledger has them."""
    frames = adapter.frames_from_events(spark, sf_dir)
    attached = _sta_totals(spark, sf_dir)
    start = (F.col("assoc_us") - F.coalesce("gap_us", F.lit(0))).alias("at_us")
    found = roaming.reclassified(roaming.slow_roams(frames), attached)
    own = verifier.judged(verifier.ledger(frames).join(attached, "assoc_num", "left"))
    return tuple(settled(x.select("sta", "ap", "assoc_num", start, "is_slow", "slow_basis", "sta_total_ms"), "results") for x in (found, own))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two results, and the number of their differences."""
    found, own = _both_results(spark, sf_dir)
    differ = verifier.compared(found, own).agg(F.count("*").alias("differences"))
    return verifier.totals(found, "library").unionByName(verifier.totals(own, "ledger")).crossJoin(differ)


def _attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.attach(_on_clock(spark, sf_dir), _recorded(spark, sf_dir))


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = stations.wpa_episodes(adapter.station_log_from_events(spark, sf_dir))
    roams = roaming.roaming_events(adapter.frames_from_events(spark, sf_dir)).where("event = 'reassoc'").withColumnRenamed("epoch_us", "assoc_us")
    return stations.offset_histogram(episodes, roams)


def _ntp_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timesync.matches(adapter.ntp_from_events(spark, sf_dir), adapter.sync_from_events(spark, sf_dir))


def _sta_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured roams and the time their station's log gives them."""
    commands = _on_clock(spark, sf_dir)
    paired = stations.attach(commands, _recorded(spark, sf_dir))
    return paired.join(commands.select("line", "total_us"), "line").select("assoc_num", (F.col("total_us") / 1000).alias("sta_total_ms"))


def _roam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = roaming.slow_roams(adapter.frames_from_events(spark, sf_dir)).select("assoc_num", (F.col("total_us") / 1000).alias("capture_total_ms"))
    return roaming.coverage(_sta_totals(spark, sf_dir).join(seen, "assoc_num"))


def _reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roaming.reclassified(roaming.slow_roams(adapter.frames_from_events(spark, sf_dir)), _sta_totals(spark, sf_dir))
    return found.select("sta", "ap", "assoc_num", "gap_us", "total_us", "sta_total_ms", "is_slow", "slow_basis")


def _last_decision(log: DataFrame) -> DataFrame:
    return stations.last_decision(log.where("event = 'roam'").withColumnRenamed("epoch_us", "cmd_us"), stations.roam_decisions(log))


def _sided(frames: DataFrame) -> DataFrame:
    """Frames of which some flows lack replies and some requests."""
    return frames.where("not (icmp_type <=> 0 and ip_dst <=> '10.0.0.10') and not (icmp_type <=> 8 and ip_src <=> '10.0.0.11')")


def _squeezed(frames: DataFrame) -> DataFrame:
    """The derived capture once more as dense, with hundreds of frames in 10 s."""
    return frames.withColumn("epoch_us", F.expr(f"{adapter.BASE_US} + (epoch_us - {adapter.BASE_US}) div 20"))


def _devices(operator: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An operator over the counts of the dense capture's devices."""

    def query(frames: DataFrame) -> DataFrame:
        dense = _squeezed(frames)
        return operator(devices.counted(dense, stats.roles(dense)))

    return query


def _severity_ping(frames: DataFrame) -> DataFrame:
    found = ping.statuses(frames).groupBy("src").agg((F.avg("rtt_us") / 1000).alias("r"), stats.percent(stats.one_if(F.col("status") == "loss"), F.count("status")).alias("l"))
    return found.select("src", thresholds.above(F.col("r"), thresholds.RTT_MS).alias("rtt_level"), thresholds.above(F.col("l"), thresholds.LOSS_PERCENT).alias("loss_level"))


def _loss_basis(frames: DataFrame) -> DataFrame:
    rows = wired.of_sender(wired.packets(frames))
    lost = F.col("rtt_us").isNull()
    truth = wired.without_tail(wired.exchanges(rows), rows).agg(F.count("*").alias("total"), stats.percent(stats.one_if(lost), F.count("*")).alias("loss_pct")).withColumn("partial", F.lit(False))
    return ping.loss_basis(truth, ping.totals(frames))


#: Columns that a capture's headers carry as they are.
CARRIED = ("epoch_us", "source", "subtype", "protocol", "retry", "mcs", "data_rate", "rssi", "ta", "ra", "bssid", "current_ap", "ip_src", "ip_dst", "icmp_type", "icmp_seq", "icmp_ident", "arp_opcode", "tcp_len", "seq", "reason_code", "channel_freq", "eapol_msgnr", "tsf")


def _through_captures(frames: DataFrame) -> DataFrame:
    """Frames written as capture files and read back in splits.

    They are dealt first: writing is much for the bytes of the table, which
    would be read by few tasks.
    """
    path = f"{shared_dir(frames.sparkSession)}/captures-{uuid.uuid4().hex}"
    capture.write_capture(dealt(frames, "number"), path)
    return capture.read_capture(frames.sparkSession, path, split_bytes=1 << 20).select(*CARRIED)


#: An hour of the derived capture, half open.
HOUR = (1_704_067_800_000_000, 1_704_071_400_000_000)


def _wired_boundary(frames: DataFrame) -> DataFrame:
    found = wired.exchanges(wired.of_sender(wired.packets(frames)))
    return wired.within(found, *HOUR, [["10.0.1.1", "10.0.0.12"]]).select("host", "target", "number", "epoch_us", "rtt_us", "late_us")


def _semi_anti(frames: DataFrame) -> DataFrame:
    """Senders by whether they are stations, APs or neither."""
    own = settled(stats.roles(frames).where("role = 'STA'").select("mac"), "stations")
    sent = frames.where(F.col("ta").isNotNull()).groupBy(F.col("ta").alias("mac")).agg(F.count("*").alias("n"))  # a row a sender before the joins
    sta = sent.join(own, "mac", "left_semi").withColumn("kind", F.lit("station"))
    rest = sent.join(own, "mac", "left_anti").withColumn("kind", F.lit("other"))
    return sta.unionByName(rest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "per_second": _frames(stats.per_second),
    "per_minute": _frames(stats.per_minute),
    "overview": _frames(stats.overview),
    "overview_kinds": _frames(stats.overview_kinds),
    "protocol_topk": _frames(stats.protocol_topk),
    "roles": _frames(stats.roles),
    "channel_map": _frames(stats.channel_map),
    "channel_distribution": _frames(stats.channel_distribution),
    "device_ips": _frames(stats.device_ips),
    "throughput": _frames(stats.throughput),
    "retry_by_mcs": _frames(stats.retry_by_mcs),
    "retry_per_sec": _frames(stats.retry_per_sec),
    "rssi_buckets": _frames(stats.rssi_buckets),
    "device_stats": _frames(stats.device_stats),
    "system_peaks": _frames(lambda f: stats.system_peaks(_squeezed(f))),
    "device_profiles": _frames(_devices(devices.profiles)),
    "device_rates": _frames(_devices(devices.rates)),
    "device_buckets": _frames(_devices(devices.buckets)),
    "device_peaks": _frames(_devices(devices.peaks)),
    "phy_mcs_grouping_sets": _frames(stats.phy_mcs_grouping_sets),
    "ap_compare_pivot": _frames(stats.ap_compare),
    "signal_quality": _frames(stats.signal_quality),
    "anomalies": _frames(stats.anomalies),
    "severity_levels": _frames(stats.severity_levels),
    "time_axis_bins": _frames(stats.time_axis_bins),
    "downsample_peak": _frames(stats.downsample_peak),
    "control_list": _frames(stats.control_list),
    "frame_rows": _frames(stats.frame_rows),
    "categories": _frames(stats.categories),
    "top_mcs_share": _frames(stats.top_mcs_share),
    "legacy_share": _frames(stats.legacy_share),
    "uniform_sample": _frames(stats.uniform_sample),
    "ping_dedup": _frames(ping.dedup),
    "ping_match": _frames(ping.matches),
    "ping_status": _frames(ping.statuses),
    "ping_cross_validation": _frames(ping.cross_validation),
    "seq_gap_loss": _frames(lambda f: ping.seq_gap_loss(ping.dedup(f).where("side = 'req'"))),
    "gap_losses_one_sided": _frames(lambda f: ping.gap_losses(_sided(f))),
    "ping_stats": _frames(ping.ping_stats),
    "ping_per_sec": _frames(ping.ping_per_sec),
    "ping_streaks": _frames(ping.streaks),
    "ping_observations": _frames(lambda f: ping.observations(_sided(f))),
    "ping_totals": _frames(lambda f: ping.totals(_sided(f))),
    "ping_devices": _frames(lambda f: ping.devices(f, stats.roles(f))),
    "ping_bins": _frames(lambda f: stats.ping_bins(ping.statuses(f), stats.time_axis(f))),
    "severity_ping": _frames(_severity_ping),
    "loss_basis": _frames(_loss_basis),
    "loss_cause": _frames(ping.loss_cause),
    "capture_mode": _frames(ping.capture_mode),
    "wired_pairs": _frames(_wired_pairs),
    "wired_sender": _frames(lambda f: wired.sender(wired.packets(f))),
    "wired_guard": _frames(lambda f: wired.wireless_guard(wired.packets(f.withColumn("subtype", F.when(F.expr("number div 10") % 3 != 0, F.col("subtype")))))),
    "wired_cohort_sender": _frames(lambda f: wired.sender(wired.cohort(wired.packets(f), *HOUR, [["10.0.0.11", "10.0.0.12"]]))),
    "wired_boundary": _frames(_wired_boundary),
    "wired_trailing": _frames(_wired_trailing),
    "wired_ground_truth": _frames(wired.ground_truth),
    "wired_loss_context": _frames(wired.loss_context),
    "exping_rows": _frames(_exping),
    "retry_bursts": _frames(signals.retry_bursts),
    "rate_fallback": _frames(signals.rate_fallback),
    "delay_zones": _frames(signals.delay_zones),
    "delay_causes": _frames(signals.delay_causes),
    "signal_cliffs": _frames(signals.cliffs),
    "cliff_pairs": _frames(signals.cliff_pairs),
    "eapol_handshakes": _frames(roaming.handshakes),
    "roam_anchor_sql": _frames(roaming.anchor_sql),
    "roam_pairing": _frames(roaming.pairing),
    "roaming_events": _frames(roaming.roaming_events),
    "roam_structured": _frames(roaming.structured),
    "four_way_match": _frames(roaming.four_way),
    "slow_roam": _frames(roaming.slow_roams),
    "roam_summary": _frames(roaming.roam_summary),
    "roam_directions": _frames(roaming.directions),
    "roam_impact": _frames(roaming.roam_impact),
    "roam_reclassified": _reclassified,
    "roam_coverage": _roam_coverage,
    "nearest_roaming": _frames(lambda f: roaming.nearest_roaming(ping.statuses(f).where("status = 'loss'").select(F.col("req_num").alias("number"), "epoch_us"), f)),
    "tsf_offset": _both(merge.tsf_offset),
    "seq_offset": _both(merge.seq_offset),
    "merge_dedup": _both(_merged),
    "coverage": _both(lambda f: merge.coverage(_merged(f))),
    "merge_summary": _both(lambda f: merge.summary(_merged(f))),
    "renumbered": _both(lambda f: merge.renumbered(merge.aligned(f)).select("number", "orig_number", "source", "epoch_us")),
    "sniffer_compare": _both(merge.sniffer_compare),
    "wpa_episodes": _log(stations.wpa_episodes),
    "scan_pairs": _log(stations.scan_pairs),
    "roam_decisions": _log(stations.roam_decisions),
    "last_scan_asof": _log(stations.last_scan),
    "last_decision_asof": _log(_last_decision),
    "station_summary": _log(lambda x: stations.summary(stations.wpa_episodes(x))),
    "sta_offset_histogram": _histogram,
    "station_attach": _attach,
    "clock_scores": _clock_scores,
    "station_bind_time": _bound,
    "rank_scores": _rank_scores,
    "station_assignment": _assigned,
    "verifier_ledger": _frames(verifier.ledger),
    "verifier_correlation": _correlated,
    "verifier_compare": _compared,
    "capture_frames": _frames(_through_captures),
    "station_bind": _frames(stations.bind_addresses),
    "ntp_match": _ntp_match,
    "ntp_device": lambda spark, sf_dir: timesync.device(_ntp_match(spark, sf_dir)),
    "ntp_offset_stats": _ntp(timesync.offset_stats),
    "ntp_drift": _ntp(timesync.drift),
    "evidence_refs": _frames(diagnosis.evidence_refs),
    "health_score": _frames(diagnosis.health_score),
    "sta_scores": _frames(diagnosis.sta_scores),
    "conclusions": _frames(diagnosis.conclusions),
    "issues": _frames(lambda f: issues.issues(_squeezed(f))),
    "incidents": _frames(diagnosis.incidents),
    "casefile": _frames(diagnosis.casefile),
    "causality": _frames(lambda f: issues.causality(issues.issues(_squeezed(f))).drop("frame_refs")),
    "semi_anti_sta": _frames(_semi_anti),
}
