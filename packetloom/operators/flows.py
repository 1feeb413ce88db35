"""Packets to bidirectional flows, and checks over flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.packet import has_flag, is_teardown
from packetloom.functions.values import seconds_between
from packetloom.operators.segments import ROWS_PER_TASK, gap_segments
from packetloom.schemas import FLOW_COLUMNS

FLOW_TIMEOUT_SECONDS = 120
COUNTED_FLAGS = ["SYN", "FIN", "RST", "ACK", "PSH"]
TCP_FAMILY = ["TCP", "HTTP", "HTTPS"]


def _partial_counts() -> dict[str, Column]:
    counts = {
        "packet_count": F.count(F.lit(1)),
        "byte_count": F.sum(F.col("length").cast("bigint")),
        "min_packet_size": F.min("length"),
        "max_packet_size": F.max("length"),
    }
    for flag in COUNTED_FLAGS:
        counts[f"tcp_{flag.lower()}_count"] = F.count_if(has_flag(flag))
    return counts


def _merged_counts() -> dict[str, Column]:
    merged = {"min_packet_size": F.min("min_packet_size"), "max_packet_size": F.max("max_packet_size")}
    for name in _partial_counts():
        merged.setdefault(name, F.sum(name))
    return merged


def _head(order: list[str]) -> Column:
    """Attributes of the first packet, kept together with its position."""
    return F.min_by(
        F.struct("src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.col("packet_id").alias("first_packet_id")),
        F.struct(*order),
    )


def finalise(flows: DataFrame, packets: str = "packet_count", size: str = "byte_count") -> DataFrame:
    """Duration, mean size and rates; rates stay null for zero duration."""
    duration = F.col("duration_seconds")
    return (
        flows.withColumn("duration_seconds", seconds_between(F.col("start_time"), F.col("end_time")))
        .withColumn("avg_packet_size", F.col(size) / F.col(packets))
        .withColumn("packets_per_second", F.when(duration > 0, F.col(packets) / duration))
        .withColumn("bytes_per_second", F.when(duration > 0, F.col(size) / duration))
    )


def capture_flows(packets: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """One row per (capture, flow) over a finished capture, in packet order.

    A FIN or RST freezes duration, mean size and rates; later packets of the flow still count.
    Packets are reduced per (flow, slice of packet ids), so no task holds more than ``slice_rows``
    packets of a flow; the freeze point is then found over one row per slice.
    """
    keys = ["capture_id", "flow_id"]
    in_slice = Window.partitionBy(*keys, "_slice")
    frozen = F.col("packet_id") <= F.col("_last_td")
    per_slice = (
        packets.select(*keys, "packet_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port",
                       "protocol", "length", "tcp_flags")
        .withColumn("_slice", F.floor(F.col("packet_id") / slice_rows))
        .withColumn("_last_td", F.max(F.when(is_teardown(), F.col("packet_id"))).over(in_slice))
        .groupBy(*keys, "_slice")
        .agg(
            *[c.alias(n) for n, c in _partial_counts().items()],
            _head(["packet_id"]).alias("_head"),
            F.min("timestamp").alias("start_time"), F.max("timestamp").alias("_end"),
            F.max("_last_td").alias("_td"),
            F.count_if(frozen).alias("_f_packets"),
            F.sum(F.when(frozen, F.col("length").cast("bigint"))).alias("_f_bytes"),
            F.max(F.when(frozen, F.col("timestamp"))).alias("_f_end"),
        )
    )
    freeze_slice = F.max(F.when(F.col("_td").isNotNull(), F.col("_slice"))).over(Window.partitionBy(*keys))

    def until_freeze(whole: str, part: str) -> Column:
        before = F.col("_freeze").isNull() | (F.col("_slice") < F.col("_freeze"))
        return F.when(before, F.col(whole)).when(F.col("_slice") == F.col("_freeze"), F.col(part))

    merged = (
        per_slice.withColumn("_freeze", freeze_slice)
        .groupBy(*keys)
        .agg(
            *[c.alias(n) for n, c in _merged_counts().items()],
            F.min_by("_head", "_slice").alias("_head"),
            F.min("start_time").alias("start_time"),
            F.max(until_freeze("_end", "_f_end")).alias("end_time"),
            F.sum(until_freeze("packet_count", "_f_packets")).alias("_packets"),
            F.sum(until_freeze("byte_count", "_f_bytes")).alias("_bytes"),
            F.max("_freeze").isNotNull().alias("_torn"),
        )
        .select("*", "_head.*")
    )
    return (
        finalise(merged, "_packets", "_bytes")
        .withColumn("is_active", F.lit(False))
        .withColumn("close_reason", F.when(F.col("_torn"), "teardown").otherwise("capture_end"))
        .select(*FLOW_COLUMNS)
    )


def live_flows(packets: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Event-time flows: FIN/RST or an idle gap beyond the timeout ends one, the next packet opens another.

    Batch twin of the streaming job; flows that nothing has closed yet are ``is_active``.
    """
    keys = ["capture_id", "flow_id"]
    rows = packets.select(*keys, "packet_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port",
                          "protocol", "length", "tcp_flags",
                          F.unix_micros("timestamp").alias("_us"))
    partial = {**_partial_counts(), "_head": _head(["_us", "packet_id"])}
    # Two local segments can share their first microsecond; the packet id then decides.
    merge = {**_merged_counts(), "_head": F.min_by("_head", F.struct("first_us", F.col("_head.first_packet_id")))}
    segments = gap_segments(rows, keys, "_us", "packet_id", timeout_seconds * 1_000_000,
                            partial, merge, closes=is_teardown(), rows_per_task=rows_per_task)
    timed = segments.select(
        "*", "_head.*", F.timestamp_micros("first_us").alias("start_time"),
        F.timestamp_micros("last_us").alias("end_time"),
    )
    return finalise(timed)


def close_at(segments: DataFrame, now_us: Column | int, timeout_seconds: int = FLOW_TIMEOUT_SECONDS) -> DataFrame:
    """Mark what is closed as of ``now_us``; a segment ends by teardown or by an idle gap."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    expired = now - F.col("last_us") > timeout_seconds * 1_000_000
    return (
        segments.withColumn("is_active", ~(F.col("closed") | expired))
        .withColumn("close_reason", F.when(F.col("closed"), "teardown").when(expired, "timeout").otherwise("open"))
        .select(*FLOW_COLUMNS)
    )


def tcp_health(flows: DataFrame) -> DataFrame:
    """Per capture: half-open handshakes, reset-heavy flows and many-small-ACK flows."""
    incomplete = (F.col("tcp_syn_count") > 0) & (F.col("tcp_ack_count") == 0)
    small_acks = (
        (F.col("packet_count") > 10) & (F.coalesce("avg_packet_size", F.lit(0.0)) < 80)
        & (F.col("tcp_ack_count") > F.col("packet_count") * 0.6)
    )
    return (
        flows.where(F.col("protocol").isin(TCP_FAMILY))
        .groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("tcp_flow_count"),
            F.count_if(incomplete).alias("incomplete_handshakes"),
            F.count_if(F.col("tcp_rst_count") > 5).alias("rst_storms"),
            F.count_if(small_acks).alias("retransmission_hints"),
        )
    )


def port_scanners(flows: DataFrame, min_ports: int = 10) -> DataFrame:
    """Sources whose SYN-bearing TCP flows reach ``min_ports`` distinct destination ports.

    Distinct pairs are formed first, so a busy source is reduced before it is shuffled; a source
    has at most 65,536 ports, which bounds its list.
    """
    return (
        flows.where(F.col("protocol").isin(TCP_FAMILY) & (F.col("tcp_syn_count") > 0))
        .groupBy("capture_id", "src_ip", "dst_port")
        .agg(F.min("first_packet_id").alias("_first"))
        .groupBy("capture_id", "src_ip")
        .agg(
            F.count(F.lit(1)).alias("port_count"),
            F.sort_array(F.collect_list("dst_port")).alias("ports"),
            F.min("_first").alias("first_packet_id"),
        )
        .where(F.col("port_count") >= min_ports)
    )


def inter_arrival(packets: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """Seconds since the capture's previous packet, null for the first one.

    A capture may be arbitrarily long, so the lag runs inside slices of packet ids; each slice's
    first packet takes the last time of the slice before it from a table of one row per slice.
    """
    sliced = packets.withColumn("_slice", F.floor(F.col("packet_id") / slice_rows))
    carried = (
        sliced.groupBy("capture_id", "_slice")
        .agg(F.max_by("timestamp", "packet_id").alias("_tail"))
        .withColumn("_before", F.lag("_tail").over(Window.partitionBy("capture_id").orderBy("_slice")))
        .select("capture_id", "_slice", "_before")
    )
    w = Window.partitionBy("capture_id", "_slice").orderBy("packet_id")
    previous = F.coalesce(F.lag("timestamp").over(w), F.col("_before"))
    return (
        sliced.join(carried, ["capture_id", "_slice"])
        .withColumn("inter_arrival_time", seconds_between(previous, F.col("timestamp")))
        .drop("_slice", "_before")
    )
