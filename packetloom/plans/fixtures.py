"""Derived inputs over the driver tables: scored flows and an anomaly table.

The driver tables hold no detector output, so scores are computed from the flows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.anomalies import RuleThresholds, ensemble, severity

# Thresholds low enough for the driver tables to reach every rule.
RULES = RuleThresholds(scan_syn=0, scan_ack=2, scan_seconds=100.0, dns_packets=5, exfil_bytes=4000, rst=0,
                       loris_packets=2, loris_size=900.0)
IF_FLAG = 0.75
AE_FLAG = 0.8


def detector_scores(flows: DataFrame) -> DataFrame:
    b, n = F.col("byte_count"), F.col("packet_count")
    return (
        flows.withColumn("if_score", F.when(n % 7 != 6, F.round((b % 997) / F.lit(996.0), 4)))
        .withColumn("ae_score", F.when(b % 11 != 0, F.round((b * 31 % 1009) / F.lit(1008.0), 4)))
        .withColumn("if_flag", F.col("if_score") >= IF_FLAG)
        .withColumn("ae_flag", F.col("ae_score") >= AE_FLAG)
    )


def scored_flows(flows: DataFrame) -> DataFrame:
    return ensemble(detector_scores(flows), ["if_score", "ae_score"], ["if_flag", "ae_flag"], RULES)


def anomaly_table(scored: DataFrame) -> DataFrame:
    """One detection per flow and a second, weaker one for every third flow."""
    rounds = F.when(F.col("byte_count") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    score = F.when(F.col("round") == 0, F.col("ensemble_score")).otherwise(F.col("ensemble_score") / 2)
    flagged = F.col("is_anomaly") & ((F.col("round") == 0) | (F.col("byte_count") % 2 == 0))
    return (
        scored.withColumn("round", F.explode(rounds))
        .withColumn("_score", score)
        .withColumn("_flagged", flagged)
        .select(
            F.concat("flow_id", F.lit("-"), F.col("round").cast("string")).alias("anomaly_id"),
            "capture_id", "flow_id", "start_time", F.lit("ensemble").alias("detector_name"),
            "if_score", "ae_score", F.round("_score", 6).alias("ensemble_score"),
            F.col("_flagged").alias("is_anomaly"),
            F.when(F.col("_flagged"), F.col("anomaly_type")).alias("anomaly_type"),
            severity(F.round("_score", 6), F.col("_flagged")).alias("severity"),
            F.when(F.col("byte_count") % 5 != 0, F.concat(F.lit("Score pattern of "), F.col("protocol"),
                   F.lit(" traffic looked unlike the rest of this capture and should be reviewed by hand."))
                   ).alias("explanation"),
            F.timestamp_micros(F.unix_micros("end_time") + (F.col("round") + 1) * 60_000_000).alias("detected_at"),
        )
    )
