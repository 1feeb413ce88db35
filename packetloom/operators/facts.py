"""Everything summaries need, from one pass over the packets and one over the scored flows.

Both passes are grouping sets: a row is counted for its label, its sender, its name and its host at once, combined before the shuffle.
What comes out are partial rows (capture, kind, key, counts, first and last times) that add up, so facts of several
captures, days or batches are united by summing again (:func:`merged`). They are written once; summaries, text chunks and
suggested questions are cut from them and do not touch the tables again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import endpoint
from packetloom.functions.values import seconds_between, text
from packetloom.operators.flows import TCP_FAMILY
from packetloom.operators.stats import top_per
from packetloom.runtime import materialize

PACKET_KINDS = ["protocol", "talker", "dns", "host"]
FLOW_KINDS = ["type", "severity", "scan", "flagged", "half_open"]
_TCP_COUNTS = ["tcp_flow_count", "incomplete_handshakes", "rst_storms", "retransmission_hints"]


def _filled(c: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.col(c))


def _kind(kinds: list[str], whole: str | None = None) -> Column:
    chosen = F.lit(whole)
    for k in kinds:
        chosen = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(chosen)
    return chosen


def packet_facts(packets: DataFrame) -> DataFrame:
    """(capture_id, kind, key, n, bytes, first_seen, last_seen, first_id): packets by label, sender, DNS name and HTTP host."""
    rows = packets.select("capture_id", "packet_id", "timestamp", F.col("length").cast("bigint").alias("length"), "protocol",
                          F.col("src_ip").alias("talker"), _filled("dns_query").alias("dns"), _filled("http_host").alias("host"))
    grouped = rows.groupingSets([["capture_id", k] for k in PACKET_KINDS], "capture_id", *PACKET_KINDS).agg(
        _kind(PACKET_KINDS).alias("kind"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0).cast("bigint")).alias("bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("packet_id").alias("first_id"))
    key = F.coalesce(*PACKET_KINDS)
    return grouped.where(key.isNotNull() | F.col("kind").isin("protocol", "talker")).select(
        "capture_id", "kind", key.alias("key"), "n", "bytes", "first_seen", "last_seen", "first_id")


def merged(facts: DataFrame) -> DataFrame:
    """Packet facts of several parts as one."""
    return facts.groupBy("capture_id", "kind", "key").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.min("first_id").alias("first_id"))


def flow_facts(scored: DataFrame, kinds: list[str] = FLOW_KINDS) -> DataFrame:
    """(capture_id, kind, item, n, flagged, first_id, TCP counts): flows as a whole, by type, severity and scanned port, and the listed ones."""
    flagged = F.coalesce("is_anomaly", F.lit(False))
    tcp = F.col("protocol").isin(TCP_FAMILY)
    syn = tcp & (F.col("tcp_syn_count") > 0)
    half_open = syn & (F.col("tcp_ack_count") == 0)
    small_acks = tcp & (F.col("packet_count") > 10) & (F.coalesce("avg_packet_size", F.lit(0.0)) < 80) & (
        F.col("tcp_ack_count") > F.col("packet_count") * 0.6)
    place = [F.col("first_packet_id").alias("at"), F.col("flow_id").alias("id")]

    def item(name: Column | None = None, port: Column | None = None, at=None) -> Column:
        none = F.lit(None)
        return F.struct((none.cast("string") if name is None else name).alias("name"), (none.cast("int") if port is None else port).alias("port"),
                        *(at or [none.cast("bigint").alias("at"), none.cast("string").alias("id")]))

    rows = scored.select(
        "capture_id", "first_packet_id", flagged.alias("_flagged"), *[c.alias(n) for n, c in zip(_TCP_COUNTS, (
            tcp, half_open, tcp & (F.col("tcp_rst_count") > 5), small_acks))],
        F.when(flagged, item(F.coalesce("anomaly_type", F.lit("unknown")))).alias("type"),
        F.when(flagged, item(F.coalesce("severity", F.lit("unknown")))).alias("severity"),
        F.when(syn, item(F.col("src_ip"), F.col("dst_port"))).alias("scan"),
        F.when(flagged, item(at=place)).alias("flagged"),
        F.when(half_open, item(text(F.col("src_ip"), "→", endpoint("dst_ip", "dst_port", "None")), at=place)).alias("half_open"))
    sets = [["capture_id"], *[["capture_id", k] for k in kinds]]
    grouped = rows.groupingSets(sets, "capture_id", *kinds).agg(
        _kind(kinds, "all").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if("_flagged").alias("flagged_n"),
        F.min("first_packet_id").alias("first_id"), *[F.count_if(c).alias(c) for c in _TCP_COUNTS])
    found = F.coalesce(*kinds)
    return grouped.where(found.isNotNull() | (F.col("kind") == "all")).select(
        "capture_id", "kind", found.alias("item"), "n", "flagged_n", "first_id", *_TCP_COUNTS)


@dataclass
class Facts:
    packets: DataFrame
    flows: DataFrame

    def of(self, kind: str) -> DataFrame:
        return (self.packets if kind in PACKET_KINDS else self.flows).where(F.col("kind") == kind)


def collect_facts(packets: DataFrame, scored: DataFrame, flow_kinds: list[str] = FLOW_KINDS) -> Facts:
    """Both fact tables, written side by side; each input is read once."""
    parts = [(packet_facts(packets), "packet-facts"), (flow_facts(scored, flow_kinds), "flow-facts")]
    with ThreadPoolExecutor(len(parts)) as pool:
        return Facts(*pool.map(lambda part: materialize(*part), parts))


def listed(rows: DataFrame, item: Column, n: int, order: list[Column], name: str) -> DataFrame:
    """Per capture, the first ``n`` items in order as one array."""
    ranked = top_per(rows.withColumn("_item", item), ["capture_id"], order, n, "_rank")
    pairs = F.sort_array(F.collect_list(F.struct("_rank", "_item")))
    return ranked.groupBy("capture_id").agg(F.transform(pairs, lambda p: p["_item"]).alias(name))


def packet_totals(facts: Facts) -> DataFrame:
    """Packets, bytes, duration and the labels (largest first) of every capture."""
    return facts.of("protocol").groupBy("capture_id").agg(
        F.sum("n").alias("total_packets"), F.sum("bytes").alias("total_bytes"),
        seconds_between(F.min("first_seen"), F.max("last_seen")).alias("duration_seconds"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("key").alias("protocol"), "n"))).alias("protocols"))


def flow_totals(facts: Facts, min_ports: int = 10) -> DataFrame:
    """Flows and anomalies of every capture, and the number of chunks that its flows make; reads the flow facts once."""
    whole = F.col("kind") == "all"
    per_source = facts.flows.where(F.col("kind").isin("all", "scan")).groupBy("capture_id", "kind", F.col("item.name").alias("src_ip")).agg(
        F.count("item.port").alias("ports"), *[F.sum(c).alias(c) for c in ("n", "flagged_n", "tcp_flow_count")])
    some = lambda c: F.max(F.when(c, 1).otherwise(0)).cast("bigint")
    flows = F.sum(F.when(whole, F.col("n")))
    return per_source.groupBy("capture_id").agg(
        flows.alias("total_flows"), F.sum(F.when(whole, F.col("flagged_n"))).alias("total_anomalies"),
        (flows + some(whole & (F.col("flagged_n") > 0)) + some(whole & (F.col("tcp_flow_count") > 0)) + some(~whole & (F.col("ports") >= min_ports))).alias("flow_chunks"))


def totals(facts: Facts) -> DataFrame:
    flows = facts.of("all").select("capture_id", F.col("n").alias("total_flows"), F.col("flagged_n").alias("total_anomalies"))
    return packet_totals(facts).join(flows, "capture_id", "left").fillna(0, ["total_flows", "total_anomalies"])


def talkers(facts: Facts, n: int) -> DataFrame:
    """Per capture its largest senders by bytes as one array of (ip, packets, bytes)."""
    item = F.struct(F.col("key").alias("ip"), F.col("n").alias("packets"), "bytes")
    return listed(facts.of("talker"), item, n, [F.col("bytes").desc(), F.col("key")], "talkers")


def names(facts: Facts, shown: int) -> DataFrame:
    """Number of DNS names and the first of them in order of appearance."""
    counts = facts.of("dns").groupBy("capture_id").agg(F.count(F.lit(1)).alias("query_count"), F.sum("n").alias("packets_with_query"))
    if not shown:
        return counts
    return counts.join(listed(facts.of("dns"), F.col("key"), shown, [F.col("first_id"), F.col("key")], "queries"), "capture_id")


def hosts(facts: Facts, shown: int) -> DataFrame:
    """Requests, number of hosts and the busiest of them."""
    counts = facts.of("host").groupBy("capture_id").agg(F.sum("n").alias("request_count"), F.count(F.lit(1)).alias("host_count"))
    item = F.struct(F.col("key").alias("host"), F.col("n").alias("requests"))
    return counts.join(listed(facts.of("host"), item, shown, [F.col("n").desc(), F.col("key")], "top_hosts"), "capture_id")


def scanners(facts: Facts, min_ports: int) -> DataFrame:
    """Sources with SYNs to at least ``min_ports`` ports; a source has 65,536 ports at most, which bounds its list."""
    return facts.of("scan").groupBy("capture_id", F.col("item.name").alias("src_ip")).agg(
        F.count("item.port").alias("port_count"), F.sort_array(F.collect_list("item.port")).alias("ports"),
        F.min("first_id").alias("first_packet_id")).where(F.col("port_count") >= min_ports)


def packet_chunks(facts: Facts) -> DataFrame:
    """Number of chunks that a capture's packets make: the summary and every family that has something to say."""
    some = lambda k: F.max(F.when(F.col("kind") == k, 1).otherwise(0)).cast("bigint")
    return facts.packets.groupBy("capture_id").agg((F.lit(1) + some("talker") + some("dns") + some("host")).alias("packet_chunks"))


def capture_summary(facts: Facts, min_ports: int = 10) -> DataFrame:
    """One row per capture; ``chunk_count`` is known without building the chunks."""
    label = lambda p: F.struct(p["protocol"].alias("protocol"), p["n"].alias("n"))
    by_label = F.map_from_entries(F.sort_array(F.transform("protocols", label)))
    return (
        packet_totals(facts).withColumn("protocol_counts", by_label).drop("protocols")
        .join(packet_chunks(facts), "capture_id")
        .join(flow_totals(facts, min_ports), "capture_id", "left")
        .join(names(facts, 0).select("capture_id", F.col("query_count").alias("dns_query_count")), "capture_id", "left")
        .join(talkers(facts, 5).withColumnRenamed("talkers", "top_talkers"), "capture_id", "left")
        .fillna(0, ["dns_query_count", "total_flows", "total_anomalies", "flow_chunks"])
        .withColumn("chunk_count", F.col("packet_chunks") + F.col("flow_chunks")).drop("packet_chunks", "flow_chunks")
    )
