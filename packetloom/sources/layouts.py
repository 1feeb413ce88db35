"""Stored layouts of the packet, flow and anomaly tables: partitioned by period, bucketed by flow.

Periods (days by default) become folders, so a period filter never lists the others; within a period rows are dealt to a fixed number of
buckets by ``flow_id`` and sorted. A lookup reads one bucket, and two tables with the same buckets meet flow by flow without a
shuffle. ``flow_id`` is the only bucket column: Spark prunes buckets by a single column, and one capture's rows of a flow
stay in the same bucket as all others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.anomalies import REPORT_FIELDS, latest_anomaly
from packetloom.runtime import broadcast_if_small

PERIOD = "period"
BUCKETS = 16


def period(time: Column | str, unit: str = "DAY") -> Column:
    return F.date_trunc(unit, time)


def store(df: DataFrame, path: str, time: str, unit: str = "DAY", buckets: int = BUCKETS, name: str | None = None) -> str:
    """Write ``df`` as a table below ``path``; returns its name in the session's catalog.

    Rows are dealt by (period, bucket) first, so that each bucket of a period becomes one file; a hot flow makes one larger file a period.
    """
    name = name or f"layout_{uuid.uuid4().hex}"
    placed = df.withColumn(PERIOD, period(time, unit))
    bucket = F.pmod(F.hash("flow_id"), F.lit(buckets))  # the hash that bucketing itself uses
    (placed.repartition(F.col(PERIOD), bucket).write.option("path", path).partitionBy(PERIOD).bucketBy(buckets, "flow_id").sortBy("flow_id", time)
     .saveAsTable(name))
    return name


def in_period(spark: SparkSession, name: str, time: str, start: Column, end: Column, unit: str = "DAY") -> DataFrame:
    """Rows with ``start <= time <= end``; only the folders of those periods are listed and read."""
    folders = F.col(PERIOD).between(period(start, unit), period(end, unit))
    return spark.table(name).where(folders & (F.col(time) >= start) & (F.col(time) <= end)).drop(PERIOD)


def in_periods_of(spark: SparkSession, name: str, chosen: DataFrame, time: str, unit: str = "DAY") -> DataFrame:
    """Rows of the periods in which ``chosen`` has rows; which folders those are is found while the query runs."""
    wanted = chosen.select(period(time, unit).alias(PERIOD)).distinct()
    return spark.table(name).join(broadcast_if_small(wanted), PERIOD, "left_semi").drop(PERIOD)


def flow(spark: SparkSession, name: str, flow_id: str | Column) -> DataFrame:
    """All rows of one flow, from the one bucket that can hold it."""
    return spark.table(name).where(F.col("flow_id") == flow_id).drop(PERIOD)


def _same_capture(left: str, right: str) -> Column:
    """Equality that stays a filter: as a join key it would ask for a shuffle by (flow, capture)."""
    a, b = F.col(f"{left}.capture_id"), F.col(f"{right}.capture_id")
    return (a <= b) & (a >= b)


def latest_per_flow(spark: SparkSession, anomalies: str) -> DataFrame:
    """Newest anomaly per capture and flow; a bucket holds all rows of its flows, so nothing is shuffled."""
    return latest_anomaly(spark.table(anomalies).drop(PERIOD))


def flow_report(spark: SparkSession, flows: str, anomalies: str) -> DataFrame:
    """The 20 report columns of every stored flow with its newest stored anomaly, joined bucket by bucket."""
    newest = latest_per_flow(spark, anomalies).select(
        "capture_id", "flow_id", "is_anomaly", "anomaly_type", F.col("ensemble_score").alias("anomaly_score"), "severity", "explanation")
    left = spark.table(flows).drop(PERIOD).alias("f")
    joined = left.join(newest.alias("a"), (F.col("f.flow_id") == F.col("a.flow_id")) & _same_capture("f", "a"), "left")
    kept = ["is_anomaly", "anomaly_type", "anomaly_score", "severity", "explanation"]
    return (
        joined.select("f.*", *[F.col(f"a.{c}") for c in kept])
        .withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False))).fillna("", ["anomaly_type", "severity", "explanation"])
        .select(*REPORT_FIELDS)
    )
