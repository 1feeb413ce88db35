"""Raw frames to packet rows with column expressions.

Link, IPv4, ARP, TCP, UDP and HTTP fields are byte expressions inside the JVM. Only the names in
DNS messages need a loop; that part is one Arrow function which receives null for other frames.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.packet import flow_key, protocol_label, tcp_flag_text
from packetloom.schemas import PACKET_COLUMNS

# Protocol numbers and ports.
IPV4, ARP, VLAN_TAGS = 0x0800, 0x0806, [0x8100, 0x88A8]
LINK_RAW_IP, LINK_COOKED = [12, 101, 228], 113
TCP, UDP, ICMP = 6, 17, 1
HTTP_PORTS, DNS_PORTS = [80, 8080], [53, 5353]
_REQUEST = r"^(OPTIONS|GET|HEAD|POST|PUT|DELETE|TRACE|CONNECT) ([^\r\n]+?) HTTP/\d\.\d\r\n"
_HOST = r"(?i)^(?:[^\r\n]+\r\n)+?Host:[ \t]*([^\r\n]*)"


def _bytes(start: Column, size: int) -> Column:
    return F.substring(F.col("raw"), start, F.lit(size))


def _uint(start: Column, size: int) -> Column:
    return F.conv(F.hex(_bytes(start, size)), 16, 10).cast("int")


def _ip_text(start: Column) -> Column:
    return F.concat_ws(".", *[_uint(start + i, 1).cast("string") for i in range(4)])


def _mac_text(start: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(_bytes(start, 6))), "(..)(?!$)", "$1:")


def _dns_name(data: bytes, at: int) -> tuple[str, int]:
    """Name at ``at`` and the offset behind it; compression pointers only lead backwards."""
    labels, after, limit = [], None, at + 1
    while True:
        size = data[at]
        if size == 0:
            return ".".join(labels), after if after is not None else at + 1
        if size >= 0xC0:
            target = (size & 0x3F) << 8 | data[at + 1]
            after = at + 2 if after is None else after
            if target >= limit:
                raise ValueError("pointer does not lead backwards")
            at = limit = target
            continue
        labels.append(data[at + 1:at + 1 + size].decode("utf-8", "replace"))
        at += 1 + size


def _rdata_text(data: bytes, kind: int, at: int, size: int) -> str | None:
    if kind in (1, 28):
        return str(ipaddress.ip_address(data[at:at + size]))
    if kind in (2, 5, 12):  # NS, CNAME, PTR
        return _dns_name(data, at)[0]
    if kind in (6, 15, 33):  # SOA, MX, SRV carry named fields instead of one value
        return None
    return data[at:at + size].decode("utf-8", "replace")


def _dns_fields(data: bytes | None) -> tuple[bool, str | None, str | None]:
    if data is None:
        return False, None, None
    try:
        questions, answers = int.from_bytes(data[4:6], "big"), int.from_bytes(data[6:8], "big")
        at, query, values = 12, None, []
        for i in range(questions):
            name, at = _dns_name(data, at)
            at += 4
            query = name.rstrip(".") if i == 0 else query
        for _ in range(answers):
            _, at = _dns_name(data, at)
            kind, size = int.from_bytes(data[at:at + 2], "big"), int.from_bytes(data[at + 8:at + 10], "big")
            if at + 10 + size > len(data):
                break
            values.append(_rdata_text(data, kind, at + 10, size))
            at += 10 + size
        return True, query, ",".join(v for v in values if v is not None) if answers else None
    except (IndexError, ValueError):
        return False, None, None


_DNS_TYPE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("query", T.StringType()),
                          T.StructField("response", T.StringType())])


@F.pandas_udf(_DNS_TYPE)
def dns_fields(message: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_dns_fields(m) for m in message], columns=["ok", "query", "response"])


def dissect(frames: DataFrame) -> DataFrame:
    """One packet row per IPv4 or ARP frame; other frames and error rows are left out.

    ``length`` is the captured length. TCP payload runs to the end of the captured frame, link
    padding included. VLAN tags are skipped.
    """
    link = F.col("link_type")
    untagged = _uint(F.lit(13), 2)
    tagged = untagged.isin(VLAN_TAGS)
    twice = tagged & _uint(F.lit(17), 2).isin(VLAN_TAGS)
    located = (
        frames.where("raw is not null")
        .withColumn("_l3", F.when(link.isin(LINK_RAW_IP), 1).when(link == LINK_COOKED, 17)
                    .when(twice, 23).when(tagged, 19).otherwise(15))
        .withColumn("_ethertype", F.when(link.isin(LINK_RAW_IP), F.lit(IPV4)).otherwise(_uint(F.col("_l3") - 2, 2)))
        .withColumn("_arp", (F.col("_ethertype") == ARP) & (F.col("caplen") >= F.col("_l3") + 27))
        .withColumn("_keep", F.col("_arp") | ((F.col("_ethertype") == IPV4) & (F.col("caplen") >= F.col("_l3") + 19)))
    )
    l3 = F.col("_l3")
    is_arp, is_ip = F.col("_arp"), ~F.col("_arp")
    headers = located.withColumns({
        "_l4": l3 + (_uint(l3, 1).bitwiseAND(F.lit(15))) * 4,
        # A later fragment carries no transport header.
        "_proto": F.when(is_ip & (_uint(l3 + 6, 2).bitwiseAND(F.lit(0x1FFF)) == 0), _uint(l3 + 9, 1))
        .otherwise(F.lit(255)),
    }).withColumn("_room", F.col("caplen") - F.col("_l4") + 1).withColumns({
        "_tcp": is_ip & (F.col("_proto") == TCP) & (F.col("_room") >= 20),
        "_udp": is_ip & (F.col("_proto") == UDP) & (F.col("_room") >= 8),
    })
    l4, tcp, udp = F.col("_l4"), F.col("_tcp"), F.col("_udp")
    ported = tcp | udp
    ports = headers.withColumns({
        "src_port": F.when(ported, _uint(l4, 2)),
        "dst_port": F.when(ported, _uint(l4 + 2, 2)),
        "_payload": F.when(tcp, F.substring(
            F.col("raw"), l4 + F.shiftright(_uint(l4 + 12, 1), 4) * 4, F.col("caplen"))),
    })
    either = lambda wanted: F.col("src_port").isin(wanted) | F.col("dst_port").isin(wanted)
    message = F.when(udp & either(DNS_PORTS) & (F.col("_room") >= 20),
                     F.substring(F.col("raw"), l4 + 8, F.col("caplen")))
    text = F.when(tcp & either(HTTP_PORTS), F.make_valid_utf8(F.col("_payload").cast("string")))
    parsed = (
        # Nondeterministic for the planner: the filter below must not be moved to the scan, where the
        # header fields would all be cut out a second time to evaluate it.
        ports.withColumns({"_dns": dns_fields.asNondeterministic()(message), "_text": text})
        .where("_keep")
        .withColumn("_request", F.coalesce(F.col("_text").rlike(_REQUEST), F.lit(False)))
    )
    request = F.col("_request")
    host = F.regexp_extract("_text", _HOST, 1)
    proto = F.when(tcp, TCP).when(udp, UDP).when(F.col("_proto") == ICMP, ICMP).otherwise(255)
    return parsed.select(
        "capture_id", "packet_id", F.timestamp_micros("ts_us").alias("timestamp"),
        F.when(is_arp, _ip_text(l3 + 14)).otherwise(_ip_text(l3 + 12)).alias("src_ip"),
        F.when(is_arp, _ip_text(l3 + 24)).otherwise(_ip_text(l3 + 16)).alias("dst_ip"),
        "src_port", "dst_port",
        protocol_label(is_arp, proto, F.col("src_port"), F.col("dst_port"), request, F.col("_dns.ok")).alias("protocol"),
        F.col("caplen").alias("length"),
        F.when(is_ip, _uint(l3 + 8, 1)).alias("ttl"),
        F.when(tcp, tcp_flag_text(_uint(l4 + 13, 1))).alias("tcp_flags"),
        F.when(F.length("_payload") > 0, F.lower(F.hex(F.substring("_payload", 1, 64)))).alias("payload_preview"),
        F.col("_dns.query").alias("dns_query"), F.col("_dns.response").alias("dns_response"),
        F.when(request, F.regexp_extract("_text", _REQUEST, 1)).alias("http_method"),
        F.when(request & (host != ""), host).alias("http_host"),
        F.when(request, F.regexp_extract("_text", _REQUEST, 2)).alias("http_path"),
        F.when(is_arp, F.when(_uint(l3 + 6, 2) == 1, "request").otherwise("reply")).alias("arp_op"),
        F.when(is_arp, _mac_text(l3 + 8)).alias("arp_hwsrc"), F.when(is_arp, _mac_text(l3 + 18)).alias("arp_hwdst"),
    ).withColumn("flow_id", flow_key()).select(*PACKET_COLUMNS)
