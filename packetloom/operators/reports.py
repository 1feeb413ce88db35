"""Reports as written tables: CSV of flows, JSON summary, summary and top-anomaly tables, registry."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.values import fixed, share, text
from packetloom.operators.anomalies import flow_anomaly_report
from packetloom.operators.filters import in_period
from packetloom.operators.stats import top_talkers_by_packets

REGISTRY_DDL = (
    "name string, format string, file_path string, packet_count bigint, flow_count bigint, anomaly_count bigint, "
    "period_start timestamp, period_end timestamp, created_at timestamp"
)
REGISTRY_SHOWN = 50
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
FORMATS = ("json", "csv", "pdf")


def restrict(packets: DataFrame, flows: DataFrame, anomalies: DataFrame, start=None, end=None):
    """The three tables inside a period: packet time, flow start, detection time."""
    return (in_period(packets, "timestamp", start, end), in_period(flows, "start_time", start, end),
            in_period(anomalies, "detected_at", start, end))


def report_counts(packets: DataFrame, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row with the three counts, from three independent aggregates."""
    parts = [
        packets.agg(F.count(F.lit(1)).alias("packet_count")),
        flows.agg(F.count(F.lit(1)).alias("flow_count")),
        anomalies.where("is_anomaly").agg(F.count(F.lit(1)).alias("anomaly_count")),
    ]
    union = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return union.agg(*[F.max(c).alias(c) for c in ("packet_count", "flow_count", "anomaly_count")])


def report_summary(packets: DataFrame, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Metric/value rows of the printed report."""
    counts = report_counts(packets, flows, anomalies)
    rate = F.when(F.col("flow_count") > 0, text(
        fixed(share(F.col("anomaly_count"), F.col("flow_count")) * 100, 1), "%")).otherwise("N/A")
    rows = [("Total Packets", F.col("packet_count").cast("string")), ("Total Flows", F.col("flow_count").cast("string")),
            ("Anomalies Detected", F.col("anomaly_count").cast("string")), ("Anomaly Rate", rate)]
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows])))


def top_anomalies(anomalies: DataFrame, n: int = 20) -> DataFrame:
    """Highest scores first, long texts cut with an ellipsis."""
    def cut(c: str, size: int):
        return F.when(F.length(c) > size, text(F.substring(c, 1, size), "…")).otherwise(F.coalesce(c, F.lit("")))

    score = F.col("ensemble_score")
    return (
        anomalies.where("is_anomaly").orderBy(score.desc_nulls_last(), "anomaly_id").limit(n)
        .select(cut("flow_id", 20).alias("flow_id"), F.coalesce("anomaly_type", F.lit("unknown")).alias("type"),
                F.coalesce("severity", F.lit("")).alias("severity"),
                F.when(score != 0, fixed(score, 3)).otherwise("").alias("score"),
                cut("explanation", 80).alias("explanation"))
    )


def json_parts(packets: DataFrame, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Summary counts, packets per label and top talkers as (part, key, n) rows."""
    counts = report_counts(packets, flows, anomalies)
    summary = counts.select(F.lit("summary").alias("part"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in counts.columns])))
    labels = packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("protocol_breakdown").alias("part"), F.col("protocol").alias("key"), "n")
    talkers = top_talkers_by_packets(packets).select(
        F.lit("top_talkers").alias("part"), F.col("ip").alias("key"), F.col("packets").alias("n"))
    return summary.unionByName(labels).unionByName(talkers)


def anomaly_entries(anomalies: DataFrame) -> DataFrame:
    return anomalies.where("is_anomaly").select(
        "flow_id", F.col("anomaly_type").alias("type"), "severity", F.col("ensemble_score").alias("score"), "explanation",
        F.date_format("detected_at", ISO_TIME).alias("detected_at"))


def json_document(parts: DataFrame, start=None, end=None, generated_at: str | None = None) -> DataFrame:
    """The one-row JSON head of a report; only a few dozen part rows are gathered."""
    def entries(part: str):
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct((-F.col("n")).alias("m"), "key", "n"))))

    as_map = lambda p: F.map_from_entries(F.transform(entries(p), lambda e: F.struct(e["key"], e["n"])))
    talkers = F.transform(entries("top_talkers"), lambda e: F.struct(e["key"].alias("ip"), e["n"].alias("packets")))
    iso = lambda v: F.lit(v.isoformat() if v is not None else None).cast("string")
    return parts.agg(F.to_json(F.struct(
        F.lit(generated_at or datetime.now(timezone.utc).isoformat()).alias("generated_at"),
        F.struct(iso(start).alias("start"), iso(end).alias("end")).alias("period"), as_map("summary").alias("summary"),
        as_map("protocol_breakdown").alias("protocol_breakdown"), talkers.alias("top_talkers"),
    ), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def generate_report(spark: SparkSession, name: str, fmt: str, out_dir: str, packets: DataFrame, flows: DataFrame,
                    anomalies: DataFrame, start: datetime | None = None, end: datetime | None = None,
                    created_at: datetime | None = None, ignore_period: bool = False) -> DataFrame:
    """Write one report below ``out_dir`` and append it to the registry; returns the registry row.

    json: ``summary`` (one document) and ``anomalies`` (one JSON line per anomaly); csv: the 20-column
    flow table; pdf: the two tables a page layout would show. Every part is written by the tasks.
    """
    if fmt not in FORMATS:
        raise ValueError(f"reports are written as {', '.join(FORMATS)}, not as {fmt!r}")
    created = created_at or datetime.now(timezone.utc)
    path = f"{out_dir.rstrip('/')}/{name}_{created:%Y%m%d_%H%M%S}.{fmt}"
    if not ignore_period:
        packets, flows, anomalies = restrict(packets, flows, anomalies, start, end)
    if fmt == "csv":
        flow_anomaly_report(flows, anomalies).write.mode("errorifexists").option("header", True).option(
            "timestampFormat", ISO_TIME).csv(path)
    elif fmt == "json":
        json_document(json_parts(packets, flows, anomalies), start, end).write.text(f"{path}/summary")
        anomaly_entries(anomalies).write.option("ignoreNullFields", "false").json(f"{path}/anomalies")
    else:
        report_summary(packets, flows, anomalies).write.parquet(f"{path}/summary")
        top_anomalies(anomalies).write.parquet(f"{path}/top_anomalies")
    row = report_counts(packets, flows, anomalies).select(
        F.lit(name).alias("name"), F.lit(fmt).alias("format"), F.lit(path).alias("file_path"),
        "packet_count", "flow_count", "anomaly_count", F.lit(start).cast("timestamp").alias("period_start"),
        F.lit(end).cast("timestamp").alias("period_end"), F.lit(created).cast("timestamp").alias("created_at"))
    row.write.mode("append").parquet(f"{out_dir.rstrip('/')}/registry")
    return spark.read.schema(REGISTRY_DDL).parquet(f"{out_dir.rstrip('/')}/registry").where(F.col("file_path") == path)


def list_reports(spark: SparkSession, out_dir: str, n: int = REGISTRY_SHOWN) -> DataFrame:
    registry = spark.read.schema(REGISTRY_DDL).parquet(f"{out_dir.rstrip('/')}/registry")
    return registry.orderBy(F.col("created_at").desc(), "file_path").limit(n)


def find_report(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The registry rows of one report, newest first; none if there is no such report."""
    registry = spark.read.schema(REGISTRY_DDL).parquet(f"{out_dir.rstrip('/')}/registry")
    return registry.where(F.col("name") == name).orderBy(F.col("created_at").desc(), "file_path")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The head of a written JSON report as (part, key, n) rows."""
    ddl = "summary map<string, bigint>, protocol_breakdown map<string, bigint>, top_talkers array<struct<ip: string, packets: bigint>>"
    head = spark.read.schema(ddl).option("multiLine", True).json(f"{path}/summary")
    maps = [head.select(F.lit(part).alias("part"), F.explode(part).alias("key", "n")) for part in ("summary", "protocol_breakdown")]
    talkers = head.select(F.inline("top_talkers")).select(F.lit("top_talkers").alias("part"), F.col("ip").alias("key"), F.col("packets").alias("n"))
    return maps[0].unionByName(maps[1]).unionByName(talkers)
