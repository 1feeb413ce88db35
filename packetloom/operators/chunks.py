"""Captures as searchable text: eight families of chunks, each a DataFrame, united at the end.

All but the chunk of a single flow come from the facts of a capture (``operators.facts``). Lists inside a text are short by definition (8 talkers, 60 names, ...): they are ranked first and
only the listed rows are collected. Complete lists stay available as row tables
(``stats.dns_names``, ``stats.http_hosts``, ``flows.port_scanners``, the scored flows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import endpoint
from packetloom.functions.values import fixed, number, text
from packetloom.operators.facts import Facts, collect_facts, hosts, listed, names, scanners, talkers, totals
from packetloom.operators.flows import TCP_FAMILY
from packetloom.schemas import CHUNK_COLUMNS

KB, MB = 1024.0, 1_048_576.0


def label_id(label: Column | str) -> Column:
    """First 12 hex digits of md5 over a label."""
    c = F.lit(label) if isinstance(label, str) else label
    return F.substring(F.md5(c.cast("binary")), 1, 12)


def _chunk(df: DataFrame, label: Column | str, category: str, content: Column, metadata: Column) -> DataFrame:
    return df.select("capture_id", label_id(label).alias("chunk_id"), F.lit(category).alias("category"),
                     content.alias("content"), F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"))


def summary_chunk(facts: Facts) -> DataFrame:
    share = lambda p: text(p["protocol"], " (", number(p["n"]), " packets, ",
                           fixed(p["n"] / F.col("total_packets") * 100, 1), "%)")
    content = text(
        "Capture file: ", F.col("capture_id"), ". Total packets: ", number("total_packets"),
        ". Total data transferred: ", fixed(F.col("total_bytes") / KB, 1), " KB (", fixed(F.col("total_bytes") / MB, 2),
        " MB). Capture duration: ", fixed(F.col("duration_seconds"), 2), " seconds. Unique network flows: ",
        number("total_flows"), ". Anomalies detected: ", number("total_anomalies"), ". Protocol breakdown: ",
        F.array_join(F.transform("protocols", share), ", "), ".",
    )
    return _chunk(totals(facts), "global_summary", "global_summary", content,
                  F.struct("total_packets", "total_flows", "duration_seconds", F.col("total_anomalies").alias("anomaly_count")))


def talker_chunk(facts: Facts) -> DataFrame:
    line = lambda t: text(t["ip"], " sent ", number(t["packets"]), " packets (",
                          fixed(t["bytes"] / KB, 1), " KB)")
    content = text("Top hosts by data volume: ",
                   F.array_join(F.transform(F.slice("talkers", 1, 8), line), "; "), ".")
    return _chunk(talkers(facts, 10), "top_talkers", "talker", content, F.struct("talkers"))


def dns_chunk(facts: Facts) -> DataFrame:
    n = F.col("query_count")
    content = text("DNS queries observed (", number(n), " unique domains): ",
                   F.array_join(F.slice("queries", 1, 60), ", "), F.when(n > 60, "...").otherwise("."))
    return _chunk(names(facts, 100), "dns_events", "dns", content, F.struct("query_count", "queries"))


def http_chunk(facts: Facts) -> DataFrame:
    line = lambda h: text(h["host"], " (", number(h["requests"]), " requests)")
    content = text("HTTP traffic observed: ", number("request_count"), " total requests to ", number("host_count"),
                   " distinct hosts. Top HTTP hosts: ", F.array_join(F.transform("top_hosts", line), "; "), ".")
    return _chunk(hosts(facts, 20), "http_events", "http", content,
                  F.struct("request_count", "host_count", F.map_from_entries("top_hosts").alias("hosts")))


def _port(ip: str, port: str) -> Column:
    return endpoint(ip, F.when(F.col(port) != 0, F.col(port)), "*")


def flow_chunks(scored: DataFrame) -> DataFrame:
    """One chunk per flow; zero-duration flows show a rate of 0."""
    zero = F.lit(0.0)
    flags = F.when(F.col("protocol").isin(TCP_FAMILY), text(
        "TCP flags — SYN:", number("tcp_syn_count"), " FIN:", number("tcp_fin_count"), " RST:", number("tcp_rst_count"),
        " ACK:", number("tcp_ack_count"), " PSH:", number("tcp_psh_count"), ". ")).otherwise(F.lit(""))
    anomaly = F.when(F.coalesce("is_anomaly", F.lit(False)), text(
        "ANOMALY DETECTED — type: ", F.coalesce("anomaly_type", F.lit("unknown")), ", severity: ",
        F.coalesce("severity", F.lit("?")), ", ensemble score: ", fixed(F.coalesce("ensemble_score", zero), 3), ". ",
    )).otherwise(F.lit(""))
    content = text(
        "Flow ", F.substring("flow_id", 1, 8), ": ", F.col("protocol"), " ", _port("src_ip", "src_port"), " → ",
        _port("dst_ip", "dst_port"), ". Packets: ", number("packet_count"), ", bytes: ", number("byte_count"),
        ", duration: ", fixed(F.coalesce("duration_seconds", zero), 3), "s, avg packet size: ",
        fixed(F.col("avg_packet_size"), 0), "B, rate: ", fixed(F.coalesce("packets_per_second", zero), 1), " pps / ",
        fixed(F.coalesce("bytes_per_second", zero) / KB, 1), " KB/s. ", flags, anomaly,
    )
    meta = F.struct("flow_id", "src_ip", "dst_ip", "protocol",
                    F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"), "anomaly_type")
    return _chunk(scored, F.concat(F.lit("flow_"), F.col("flow_id")), "flow", content, meta)


def anomaly_chunk(facts: Facts) -> DataFrame:
    def counted(kind: str, name: str) -> DataFrame:
        pair = F.struct(F.col("item.name").alias("kind"), F.col("n").alias("c"))
        return facts.of(kind).groupBy("capture_id").agg(F.sort_array(F.collect_list(pair)).alias(name))

    ids = listed(facts.of("flagged"), F.substring("item.id", 1, 8), 20, [F.col("item.at"), F.col("item.id")], "ids")
    joined = facts.of("all").where("flagged_n > 0").select("capture_id", F.col("n").alias("flows"), F.col("flagged_n").alias("n"))
    for part in (counted("type", "types"), counted("severity", "severities"), ids):
        joined = joined.join(part, "capture_id")
    content = text(
        "Anomaly summary: ", number("n"), " anomalous flows detected out of ", number("flows"),
        " total. Types observed: ",
        F.array_join(F.transform("types", lambda t: text(number(t["c"]), " ", t["kind"], " event(s)")), "; "),
        ". Severity breakdown: ",
        F.array_join(F.transform("severities", lambda t: text(t["kind"], ": ", number(t["c"]))), ", "),
        ". Anomalous flow IDs: ", F.array_join("ids", ", "), F.when(F.col("n") > 20, "...").otherwise("."),
    )
    meta = F.struct(F.col("n").alias("anomaly_count"), F.map_from_entries("types").alias("by_type"),
                    F.map_from_entries("severities").alias("severity_counts"))
    return _chunk(joined, "anomaly_summary", "anomaly", content, meta)


def tcp_chunk(facts: Facts) -> DataFrame:
    shown = listed(facts.of("half_open"), F.col("item.name"), 10, [F.col("item.at"), F.col("item.id")], "shown")
    joined = facts.of("all").where("tcp_flow_count > 0").join(shown, "capture_id", "left")
    content = text(
        "TCP analysis over ", number("tcp_flow_count"), " TCP/HTTP/HTTPS flows: ", number("incomplete_handshakes"),
        " flows with SYN but no ACK (possible incomplete handshakes or filtered ports). ", number("rst_storms"),
        " flows with high RST count (possible connection rejections or scanning). ", number("retransmission_hints"),
        " flows show possible retransmission patterns (many small ACKs). ",
        F.when(F.col("shown").isNotNull(), text("Incomplete handshake flows involve: ", F.array_join("shown", ", "), ". "))
        .otherwise(F.lit("")),
    )
    meta = F.struct("tcp_flow_count", "incomplete_handshakes", "rst_storms",
                    F.col("retransmission_hints").alias("retransmission_hint_count"))
    return _chunk(joined, "tcp_analysis", "tcp_analysis", content, meta)


def port_scan_chunk(facts: Facts, min_ports: int = 10) -> DataFrame:
    found = scanners(facts, min_ports)
    line = text(F.col("src_ip"), " probed ", number("port_count"), " distinct ports (e.g. [",
                F.array_join(F.slice("ports", 1, 8), ", "), "]).")
    lines = listed(found, line, 5, [F.col("first_packet_id"), F.col("src_ip")], "lines")
    counted = found.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).join(lines, "capture_id")
    content = text("Potential port scan activity detected from ", number("n"), " source IP(s). ",
                   F.array_join("lines", " "))
    return _chunk(counted, "port_scan_heuristic", "port_scan", content, F.struct(F.col("n").alias("scanner_count")))


def build_chunks(packets: DataFrame, scored: DataFrame, min_ports: int = 10, facts: Facts | None = None) -> DataFrame:
    """All families; those without data for a capture are absent.

    ``scored`` is the flow table with detector columns. Packets are read once and flows twice, for their facts and for the
    chunk that each of them is; every other family is cut from the facts.
    """
    facts = facts or collect_facts(packets, scored)
    families = [
        summary_chunk(facts), talker_chunk(facts), dns_chunk(facts), http_chunk(facts),
        flow_chunks(scored), anomaly_chunk(facts), tcp_chunk(facts), port_scan_chunk(facts, min_ports),
    ]
    return reduce(lambda a, b: a.unionByName(b), families).select(*CHUNK_COLUMNS)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("capture_id", "category").agg(F.count(F.lit(1)).alias("chunks"))
