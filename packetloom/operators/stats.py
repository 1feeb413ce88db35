"""Traffic statistics over packets, flows and anomalies.

Everything is aggregated before it is ranked, so rankings only ever see one row per address,
protocol, name or host. Ties are broken by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.values import seconds_between, share


def byte_sum(c: str = "length") -> Column:
    return F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0).cast("bigint"))


def traffic_totals(packets: DataFrame, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: packets, bytes, flows, anomalies, anomaly rate in percent, capture duration."""
    none = F.lit(None).cast("bigint")
    p = packets.agg(
        F.count(F.lit(1)).alias("total_packets"), byte_sum().alias("total_bytes"),
        F.unix_micros(F.min("timestamp")).alias("_t0"), F.unix_micros(F.max("timestamp")).alias("_t1"),
        none.alias("total_flows"), none.alias("total_anomalies"),
    )
    f = flows.agg(F.count(F.lit(1)).alias("total_flows"))
    a = anomalies.where("is_anomaly").agg(F.count(F.lit(1)).alias("total_anomalies"))
    merged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p, f, a]).agg(
        *[F.max(c).alias(c) for c in ("total_packets", "total_bytes", "total_flows", "total_anomalies", "_t0", "_t1")]
    )
    return merged.select(
        "total_packets", "total_bytes", "total_flows", "total_anomalies",
        F.round(share(F.col("total_anomalies"), F.col("total_flows")) * 100, 2).alias("anomaly_rate"),
        ((F.col("_t1") - F.col("_t0")) / F.lit(1_000_000.0)).alias("capture_duration_seconds"),
    )


def protocol_breakdown(packets: DataFrame) -> DataFrame:
    """Packets, bytes and percent per label; the share window only sees the handful of labels."""
    counts = packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("count"), byte_sum().alias("bytes"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(share(F.col("count"), total) * 100, 2)).orderBy(
        F.col("count").desc(), "protocol"
    )


def _talkers(packets: DataFrame, *scope: str) -> DataFrame:
    return packets.groupBy(*scope, F.col("src_ip").alias("ip")).agg(
        F.count(F.lit(1)).alias("packets"), byte_sum().alias("bytes")
    )


def top_talkers_by_packets(packets: DataFrame, n: int = 10) -> DataFrame:
    return _talkers(packets).orderBy(F.col("packets").desc(), "ip").limit(n)


def top_per(df: DataFrame, scope: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark prunes each partition to ``n`` rows before shuffling."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_talkers_by_bytes(packets: DataFrame, n: int = 10) -> DataFrame:
    """Per capture."""
    return top_per(_talkers(packets, "capture_id"), ["capture_id"], [F.col("bytes").desc(), F.col("ip")], n)


def talker_share(packets: DataFrame, n: int = 8) -> DataFrame:
    """Bar length of each listed talker relative to the busiest one."""
    top = top_talkers_by_packets(packets).limit(n)
    return top.withColumn("bar_percent", F.col("packets") / F.max("packets").over(Window.partitionBy()) * 100)


def capture_duration(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id").agg(
        seconds_between(F.min("timestamp"), F.max("timestamp")).alias("duration_seconds")
    )


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Per capture, a map label -> packets (at most one entry per label)."""
    return (
        packets.groupBy("capture_id", "protocol").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("capture_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("protocol", "n")))).alias("protocol_counts"))
    )


def dns_names(packets: DataFrame) -> DataFrame:
    """Distinct queried names per capture with first sighting, one row per name."""
    return (
        packets.where(F.coalesce("dns_query", F.lit("")) != "")
        .groupBy("capture_id", "dns_query")
        .agg(F.min("packet_id").alias("first_packet_id"), F.count(F.lit(1)).alias("queries"))
    )


def dns_summary(packets: DataFrame, listed: int = 100) -> DataFrame:
    """Name count and the first ``listed`` names in order of appearance."""
    names = dns_names(packets)
    counts = names.groupBy("capture_id").agg(F.count(F.lit(1)).alias("query_count"))
    firsts = (
        top_per(names, ["capture_id"], [F.col("first_packet_id"), F.col("dns_query")], listed)
        .groupBy("capture_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dns_query"))),
                         lambda x: x["dns_query"]).alias("queries"))
    )
    return counts.join(firsts, "capture_id")


def http_requests(packets: DataFrame) -> DataFrame:
    return packets.where(F.coalesce("http_host", F.lit("")) != "").select(
        "capture_id", "packet_id", F.col("src_ip").alias("src"), F.col("http_host").alias("host"),
        F.col("http_method").alias("method"), F.col("http_path").alias("path"),
    )


def http_hosts(packets: DataFrame) -> DataFrame:
    """Requests per host, one row per host."""
    return http_requests(packets).groupBy("capture_id", "host").agg(F.count(F.lit(1)).alias("requests"))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Flagged rows by type and severity, one pass over the anomalies."""
    return (
        anomalies.where("is_anomaly")
        .groupBy("capture_id", F.coalesce("anomaly_type", F.lit("unknown")).alias("anomaly_type"),
                 F.coalesce("severity", F.lit("unknown")).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_sizes(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct names, hosts and labels per capture; sketches instead if asked for.

    The exact form counts over pre-grouped rows, one group set per column, because several
    ``count_distinct`` in one aggregate would multiply every packet.
    """
    wanted = {"dns_names": "dns_query", "http_hosts": "http_host", "protocols": "protocol"}
    if approximate:
        return packets.groupBy("capture_id").agg(
            *[F.approx_count_distinct(c).alias(n) for n, c in wanted.items()])
    parts = []
    for name, column in wanted.items():
        parts.append(
            packets.where(F.col(column).isNotNull()).select("capture_id", column).distinct()
            .groupBy("capture_id").agg(F.count(F.lit(1)).alias(name))
        )
    zero = {n: F.coalesce(F.max(n), F.lit(0).cast("bigint")).alias(n) for n in wanted}
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return union.groupBy("capture_id").agg(*zero.values())


def session_rollup(messages: DataFrame, session: str = "session_id", time_col: str = "ts") -> DataFrame:
    return messages.groupBy(session).agg(
        F.count(F.lit(1)).alias("message_count"), F.max(time_col).alias("last_active_at"))


def live_sessions(rollup: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Sessions idle for no longer than the time to live."""
    return rollup.where(seconds_between(F.col("last_active_at"), now) <= ttl_seconds)
