"""Table scans, and the adapter that turns the driver's event table into packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.packet import flow_key
from packetloom.runtime import spread
from packetloom.schemas import PACKET_COLUMNS

EPOCH_2024_US = 1_704_067_200_000_000
TIME_SQUEEZE = 10_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_packets(df: DataFrame, path: str) -> None:
    """Packet table laid out for the usual filters: by day, sorted by source and time in each file."""
    (
        df.withColumn("day", F.to_date("timestamp"))
        .sortWithinPartitions("day", "src_ip", "timestamp")
        .write.mode("append").partitionBy("day").parquet(path)
    )


def _octets(user: Column) -> Column:
    return F.concat(
        F.lit("10."), (F.floor(user / 62500) % 250).cast("string"), F.lit("."),
        (F.floor(user / 250) % 250).cast("string"), F.lit("."), (user % 250 + 1).cast("string"),
    )


def packets_from_events(events: DataFrame) -> DataFrame:
    """Deterministic packet table derived row by row from ``events``.

    Works on batch and streaming frames. Event time is squeezed so that 120 s idle gaps are a mix
    of hits and misses; even event ids travel client to server, odd ones back.
    """
    eid, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    squeezed = F.lit(EPOCH_2024_US) + F.floor((us - F.lit(EPOCH_2024_US)) / TIME_SQUEEZE).cast("bigint")
    etype = F.col("event_type")
    out = eid % 2 == 0

    service = (
        F.when(etype == "click", 22).when(etype == "view", 443).when(etype == "signup", 53)
        .when(etype == "error", 8080).otherwise(123)
    )
    label = (
        F.when(etype == "click", "TCP").when(etype == "view", "HTTPS").when(etype == "signup", "DNS")
        .when((etype == "error") & out, "HTTP").when(etype == "error", "TCP")
        .when(k % 10 == 0, "ICMP").when(k % 10 == 1, "ARP").otherwise("UDP")
    )
    base = events.select(
        F.concat(F.lit("cap"), (user % 4).cast("string")).alias("capture_id"),
        eid.alias("packet_id"),
        F.timestamp_micros(squeezed).alias("timestamp"),
        out.alias("_out"), k.alias("_k"), label.alias("protocol"),
        _octets(user).alias("_client"),
        F.concat(F.lit("192.168.0."), (k % 3 + 1).cast("string")).alias("_server"),
        (F.lit(40000) + user % 1000).cast("int").alias("_cport"), service.cast("int").alias("_sport"),
        (F.round(F.col("value") * 100).cast("bigint") % 1441).alias("_extra"),
    )

    portless = F.col("protocol").isin("ICMP", "ARP")
    tcp = F.col("protocol").isin("TCP", "HTTP", "HTTPS")
    http = F.col("protocol") == "HTTP"
    dns = F.col("protocol") == "DNS"
    arp = F.col("protocol") == "ARP"
    pid, flag = F.col("packet_id"), F.col("packet_id") % 17
    no_port = F.lit(None).cast("int")

    def pick(sent: str, received: str) -> Column:
        return F.when(F.col("_out"), F.col(sent)).otherwise(F.col(received))

    placed = base.select(
        "capture_id", "packet_id", "timestamp",
        pick("_client", "_server").alias("src_ip"), pick("_server", "_client").alias("dst_ip"),
        F.when(portless, no_port).otherwise(pick("_cport", "_sport")).alias("src_port"),
        F.when(portless, no_port).otherwise(pick("_sport", "_cport")).alias("dst_port"),
        "protocol",
        (F.when(http | dns, 160).otherwise(60) + F.col("_extra")).cast("int").alias("length"),
        F.when(~arp, (F.lit(32) + pid % 97).cast("int")).alias("ttl"),
        F.when(tcp, F.when(flag == 0, "SYN").when(flag == 1, "SYNACK").when(flag == 14, "PSHACK")
               .when(flag == 15, "FINACK").when(flag == 16, "RST").otherwise("ACK")).alias("tcp_flags"),
        F.when(dns, F.concat(F.lit("d"), F.col("_k").cast("string"), F.lit(".example.com"))).alias("dns_query"),
        F.when(dns & ~F.col("_out"),
               F.concat(F.lit("198.51.100."), (F.col("_k") + 1).cast("string"))).alias("dns_response"),
        F.when(http, F.when(pid % 3 == 0, "GET").when(pid % 3 == 1, "POST").otherwise("HEAD")).alias("http_method"),
        F.when(http, F.concat(F.lit("h"), (F.col("_k") % 25).cast("string"),
                              F.lit(".example.org"))).alias("http_host"),
        F.when(http, F.concat(F.lit("/p/"), (pid % 10).cast("string"))).alias("http_path"),
        F.when(arp, F.when(F.col("_out"), "request").otherwise("reply")).alias("arp_op"),
        F.when(arp, F.when(F.col("_out"), "02:00:00:00:00:01").otherwise("02:00:00:00:00:02")).alias("arp_hwsrc"),
        F.when(arp, F.when(F.col("_out"), "02:00:00:00:00:02").otherwise("02:00:00:00:00:01")).alias("arp_hwdst"),
    )
    # TCP payload: the request text for HTTP, zero bytes otherwise; the preview shows 64 bytes of it.
    preview = F.when(
        http, F.rpad(F.lower(F.hex(F.encode(http_request_text(), "UTF-8"))), 128, "0")
    ).when(
        tcp & (F.col("length") > 54), F.repeat(F.lit("00"), F.least(F.lit(64), F.col("length") - 54))
    )
    return placed.withColumn("payload_preview", preview).withColumn("flow_id", flow_key()).select(*PACKET_COLUMNS)


def http_request_text() -> Column:
    return F.concat(
        F.col("http_method"), F.lit(" "), F.col("http_path"), F.lit(" HTTP/1.1\r\nHost: "),
        F.col("http_host"), F.lit("\r\n\r\n"),
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    return packets_from_events(spread(read_table(spark, folder, "events")))
