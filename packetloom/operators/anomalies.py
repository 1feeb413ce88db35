"""Features, scaling, ensemble, severity, rule types and the joins around anomaly rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import any_of

# Fixed order of the model inputs.
FEATURES = [
    "packet_count", "byte_count", "avg_packet_size", "duration_seconds", "packets_per_second",
    "bytes_per_second", "tcp_syn_count", "tcp_fin_count", "tcp_rst_count", "tcp_ack_count",
    "tcp_psh_count", "src_port", "dst_port",
]

# Lower score bound of each severity.
SEVERITY_BOUNDS = [("low", 0.4), ("medium", 0.6), ("high", 0.8), ("critical", 0.95)]

MIN_TRAINING_FLOWS = 10


def feature_columns() -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]


def feature_vector(flows: DataFrame, *ids: str) -> DataFrame:
    return flows.select(*(ids or ("capture_id", "flow_id")), *feature_columns())


def fit_scaler(features: DataFrame) -> DataFrame:
    """One row of means and population deviations; a constant column gets scale 1."""
    aggs = []
    for f in FEATURES:
        sd = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"{f}_mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"{f}_scale")]
    return features.agg(*aggs)


def scaler_table(scaler: DataFrame) -> DataFrame:
    """The same parameters, one row per feature."""
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("mean"), F.col(f"{f}_scale").alias("scale"))
        for f in FEATURES
    ])
    return scaler.select(F.inline(rows))


def apply_scaler(features: DataFrame, scaler: DataFrame | None) -> DataFrame:
    """Scale with 26 constants read from the one-row parameter table; unfitted means unchanged."""
    if scaler is None:
        return features
    p = scaler.first()
    scaled = {f: (F.col(f) - F.lit(p[f"{f}_mean"])) / F.lit(p[f"{f}_scale"]) for f in FEATURES}
    return features.withColumns(scaled)


def enough_to_train(flows: DataFrame) -> bool:
    return flows.limit(MIN_TRAINING_FLOWS).count() >= MIN_TRAINING_FLOWS


def severity(score: Column, is_anomaly: Column) -> Column:
    band = F.lit("info")
    for name, bound in SEVERITY_BOUNDS:
        band = F.when(score >= bound, name).otherwise(band)
    return F.when(is_anomaly, band).otherwise("info")


@dataclass(frozen=True)
class RuleThresholds:
    """Fixed values by default."""

    scan_syn: int = 20
    scan_ack: int = 5
    scan_seconds: float = 5.0
    dns_packets: int = 100
    exfil_bytes: int = 50_000_000
    rst: int = 50
    loris_packets: int = 500
    loris_size: float = 100.0


def rule_type(t: RuleThresholds = RuleThresholds()) -> Column:
    """Type of an anomalous flow; the first rule that holds wins."""
    size = F.coalesce(F.col("avg_packet_size"), F.lit(0.0))
    seconds = F.coalesce(F.col("duration_seconds"), F.lit(0.0))
    return (
        F.when((F.col("tcp_syn_count") > t.scan_syn) & (F.col("tcp_ack_count") < t.scan_ack)
               & (seconds < t.scan_seconds), "port_scan")
        .when((F.col("protocol") == "DNS") & (F.col("packet_count") > t.dns_packets), "dns_spike")
        .when((F.col("byte_count") > t.exfil_bytes) & F.col("protocol").isin("TCP", "HTTPS"), "data_exfiltration")
        .when(F.col("tcp_rst_count") > t.rst, "rst_storm")
        .when((F.col("packet_count") > t.loris_packets) & (size < t.loris_size), "slow_loris")
        .otherwise("unknown")
    )


def ensemble(scored: DataFrame, scores: list[str], flags: list[str],
             thresholds: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Mean of the scores that are present (0 if none), flagged when any detector flags it."""
    present = F.array_compact(F.array(*[F.col(s) for s in scores]))
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    flagged = any_of([F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return (
        scored.withColumn("ensemble_score", F.when(F.size(present) > 0, mean).otherwise(F.lit(0.0)))
        .withColumn("is_anomaly", flagged)
        .withColumn("anomaly_type", F.when(F.col("is_anomaly"), rule_type(thresholds)))
        .withColumn("severity", severity(F.col("ensemble_score"), F.col("is_anomaly")))
    )


def fuse_detectors(flows: DataFrame, detections: list[DataFrame], keys: list[str],
                   thresholds: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Join any number of detector outputs (keys, score, is_anomaly) to the flows and fuse them."""
    joined, scores, flags = flows, [], []
    for i, d in enumerate(detections):
        joined = joined.join(
            d.select(*keys, F.col("score").alias(f"score_{i}"), F.col("is_anomaly").alias(f"flag_{i}")), keys, "left")
        scores.append(f"score_{i}")
        flags.append(f"flag_{i}")
    return ensemble(joined, scores, flags, thresholds)


def latest_anomaly(anomalies: DataFrame) -> DataFrame:
    """Newest anomaly per flow, by a partial aggregate instead of a window."""
    rest = [c for c in anomalies.columns if c not in ("capture_id", "flow_id")]
    newest = F.max_by(F.struct(*rest), F.struct("detected_at", "anomaly_id"))
    return anomalies.groupBy("capture_id", "flow_id").agg(newest.alias("_a")).select("capture_id", "flow_id", "_a.*")


REPORT_FIELDS = [
    "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time", "duration_seconds",
    "packet_count", "byte_count", "avg_packet_size", "packets_per_second", "bytes_per_second",
    "tcp_syn_count", "tcp_rst_count", "is_anomaly", "anomaly_type", "anomaly_score", "severity", "explanation",
]


def flow_anomaly_report(flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The 20 report columns, one row per flow; flows without anomaly get False and blanks."""
    newest = latest_anomaly(anomalies).select(
        "capture_id", "flow_id", "is_anomaly", "anomaly_type", F.col("ensemble_score").alias("anomaly_score"),
        "severity", "explanation")
    return (
        flows.join(newest, ["capture_id", "flow_id"], "left")
        .withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))
        .fillna("", ["anomaly_type", "severity", "explanation"])
        .select(*REPORT_FIELDS)
    )


def flows_with_latest(flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    newest = latest_anomaly(anomalies).select(
        "capture_id", "flow_id", "is_anomaly", "anomaly_type", "ensemble_score", "severity", "explanation",
        "detected_at")
    return flows.join(newest, ["capture_id", "flow_id"], "left")


def merge_live(live: DataFrame, stored: DataFrame, shown: int = 200) -> DataFrame:
    """Live rows first, then stored ones; the first sighting of an id wins.

    Both inputs carry ``position``, their own display order.
    """
    both = live.withColumn("_source", F.lit(0)).unionByName(stored.withColumn("_source", F.lit(1)))
    rest = [c for c in live.columns if c != "anomaly_id"]
    place = F.struct("_source", "position")
    return (
        both.groupBy("anomaly_id")
        .agg(F.min_by(F.struct(*rest), place).alias("_row"), F.min(place).alias("_place"))
        .orderBy("_place._source", "_place.position").limit(shown)
        .select("anomaly_id", "_row.*", F.when(F.col("_place._source") == 0, "live").otherwise("stored").alias("origin"))
    )
