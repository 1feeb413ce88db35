"""Row filters, lookups, pages and display projections over the stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import all_of, endpoint, info_text

# Capture-filter protocol names and the labels each covers.
TRANSPORT_LABELS = {
    "tcp": ["TCP", "HTTP", "HTTPS"],
    "udp": ["UDP", "DNS"],
    "icmp": ["ICMP"],
    "arp": ["ARP"],
}

# Upper limits of one page per table.
PAGE_LIMITS = {"packets": 1000, "flows": 500, "anomalies": 500}
PAGE_DEFAULTS = {"packets": 100, "flows": 50, "anomalies": 50}


@dataclass(frozen=True)
class CaptureFilter:
    """OR inside each list, AND across lists; an empty filter lets everything pass."""

    protocols: list[str] = field(default_factory=list)
    src_ips: list[str] = field(default_factory=list)
    dst_ips: list[str] = field(default_factory=list)
    src_ports: list[int] = field(default_factory=list)
    dst_ports: list[int] = field(default_factory=list)

    @staticmethod
    def default() -> CaptureFilter:
        return CaptureFilter(protocols=list(TRANSPORT_LABELS))

    def condition(self) -> Column:
        labels = [label for p in self.protocols for label in TRANSPORT_LABELS[p.lower()]]
        wanted = {"protocol": labels, "src_ip": self.src_ips, "dst_ip": self.dst_ips,
                  "src_port": self.src_ports, "dst_port": self.dst_ports}
        return all_of([F.col(name).isin(values) for name, values in wanted.items() if values])


def capture_filter(packets: DataFrame, spec: CaptureFilter | None = None) -> DataFrame:
    return packets.where((spec or CaptureFilter.default()).condition())


def _equals(df: DataFrame, **wanted) -> DataFrame:
    return df.where(all_of([F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]))


def filter_packets(packets, protocol=None, src_ip=None, dst_ip=None, flow_id=None) -> DataFrame:
    return _equals(packets, protocol=protocol.upper() if protocol else None, src_ip=src_ip or None,
                   dst_ip=dst_ip or None, flow_id=flow_id or None)


def filter_flows(flows, protocol=None, src_ip=None, active_only=False) -> DataFrame:
    kept = _equals(flows, protocol=protocol.upper() if protocol else None, src_ip=src_ip or None)
    return kept.where("is_active") if active_only else kept


def filter_anomalies(anomalies, only_anomalies=True, severity=None, anomaly_type=None) -> DataFrame:
    kept = _equals(anomalies, severity=severity or None, anomaly_type=anomaly_type or None)
    return kept.where("is_anomaly") if only_anomalies else kept


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; no row means not found."""
    return df.where(F.col(key) == F.lit(value))


def in_period(df: DataFrame, time_col: str, start=None, end=None) -> DataFrame:
    """Both ends inclusive, each optional."""
    bounds = []
    if start is not None:
        bounds.append(F.col(time_col) >= F.lit(start))
    if end is not None:
        bounds.append(F.col(time_col) <= F.lit(end))
    return df.where(all_of(bounds))


def page(df: DataFrame, table: str, time_col: str, tie: list[str], limit: int | None = None,
         offset: int = 0) -> DataFrame:
    """Newest first with a fixed tie-break; planned as a per-partition top-N."""
    limit = PAGE_DEFAULTS[table] if limit is None else limit
    if not 0 <= limit <= PAGE_LIMITS[table] or offset < 0:
        raise ValueError(f"limit must be 0..{PAGE_LIMITS[table]} and offset >= 0")
    return df.orderBy(F.col(time_col).desc(), *[F.col(t).asc() for t in tie]).offset(offset).limit(limit)


def live_text_filter(packets: DataFrame, text: str, shown: int = 200) -> DataFrame:
    """Substring search: addresses case-sensitive, protocol not; newest 200 rows."""
    kept = packets
    if text:
        kept = packets.where(
            F.col("src_ip").contains(text) | F.col("dst_ip").contains(text)
            | F.lower("protocol").contains(text.lower())
        )
    return latest(kept, "timestamp", ["packet_id"], shown)


def latest(df: DataFrame, time_col: str, tie: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows (the live view keeps 500 packets and 100 anomalies)."""
    return df.orderBy(F.col(time_col).desc(), *[F.col(t).asc() for t in tie]).limit(n)


def packet_display(packets: DataFrame) -> DataFrame:
    return packets.select(
        "packet_id", "timestamp", "protocol",
        endpoint("src_ip", "src_port", "*").alias("source"),
        endpoint("dst_ip", "dst_port", "*").alias("destination"),
        "length", F.coalesce("tcp_flags", F.lit("—")).alias("flags"), info_text().alias("info"),
    )


def flow_display(flows: DataFrame) -> DataFrame:
    return flows.select(
        "flow_id", "start_time", "protocol",
        endpoint("src_ip", "src_port", "*").alias("source"),
        endpoint("dst_ip", "dst_port", "*").alias("destination"),
        "packet_count", (F.col("byte_count") / 1024).alias("kilobytes"),
        "duration_seconds", "packets_per_second",
    )


def anomaly_display(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(
        "anomaly_id", "severity", "anomaly_type", "flow_id",
        F.round(F.col("ensemble_score") * 100).cast("bigint").alias("score_percent"), "explanation",
    )


def live_event(packets: DataFrame) -> DataFrame:
    """The 11 fields shown by the live feed."""
    return packets.select("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                          "length", "tcp_flags", "flow_id", "dns_query", "http_host")
