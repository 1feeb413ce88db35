"""Frames and capture files made from a packet table, to exercise the scan and the dissector.

Encoding is plain SQL on the packet columns, so the amount of work follows the input table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packet import TCP_FLAG_BITS
from packetloom.sources.tables import http_request_text


def _hex(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(c.cast("bigint")), digits, "0")


def _ip_hex(c: str) -> Column:
    return F.concat(*[_hex(F.split(c, r"\.")[i].cast("int"), 2) for i in range(4)])


def _name_hex(c: Column) -> Column:
    labels = F.transform(F.split(c, r"\."), lambda x: F.concat(_hex(F.length(x), 2), F.hex(F.encode(x, "UTF-8"))))
    return F.concat(F.array_join(labels, ""), F.lit("00"))


def frames_from_packets(packets: DataFrame) -> DataFrame:
    protocol = F.col("protocol")
    tcp = protocol.isin("TCP", "HTTP", "HTTPS")
    bits = sum((F.when(F.col("tcp_flags").contains(n), b).otherwise(0) for n, b in TCP_FLAG_BITS.items()), F.lit(0))
    ports = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4))
    tcp_hex = F.concat(
        ports, F.lit("0000000000000000"), F.lit("50"), _hex(bits, 2), F.lit("FFFF00000000"),
        F.when(protocol == "HTTP", F.hex(F.encode(http_request_text(), "UTF-8"))).otherwise(F.lit("")),
    )
    answered = F.col("dns_response").isNotNull()
    dns_hex = F.concat(
        F.lit("0000"), F.when(answered, "8180").otherwise("0100"), F.lit("0001"),
        F.when(answered, "0001").otherwise("0000"), F.lit("00000000"), _name_hex(F.col("dns_query")), F.lit("00010001"),
        F.when(answered, F.concat(F.lit("C00C000100010000003C0004"), _ip_hex("dns_response"))).otherwise(F.lit("")),
    )
    udp_hex = F.concat(ports, F.lit("00000000"), F.when(protocol == "DNS", dns_hex).otherwise(F.lit("")))
    body = F.when(tcp, tcp_hex).when(protocol == "ICMP", F.lit("0800000000000000")).otherwise(udp_hex)
    number = F.when(tcp, "06").when(protocol == "ICMP", "01").otherwise("11")
    ip_hex = F.concat(
        F.lit("4500"), _hex(F.col("length") - 14, 4), F.lit("00004000"), _hex(F.col("ttl"), 2), number, F.lit("0000"),
        _ip_hex("src_ip"), _ip_hex("dst_ip"), body,
    )
    mac = lambda c: F.regexp_replace(c, ":", "")
    arp_hex = F.concat(
        F.lit("000108000604"), F.when(F.col("arp_op") == "request", "0001").otherwise("0002"),
        mac("arp_hwsrc"), _ip_hex("src_ip"), mac("arp_hwdst"), _ip_hex("dst_ip"),
    )
    ethernet = F.lit("020000000002020000000001")
    frame = F.when(protocol == "ARP", F.concat(ethernet, F.lit("0806"), arp_hex)).otherwise(
        F.concat(ethernet, F.lit("0800"), ip_hex))
    return packets.select(
        "capture_id", "packet_id", F.unix_micros("timestamp").alias("ts_us"), F.col("length").alias("caplen"),
        F.lit(1).alias("link_type"), F.unhex(F.rpad(frame, F.col("length") * 2, "0")).alias("raw"),
        F.lit(None).cast("string").alias("error"),
    )


def write_captures(frames: DataFrame, folder: str, packets_per_file: int = 20_000) -> DataFrame:
    """Write classic little-endian capture files, one per capture and block of packet ids.

    Files land below ``folder``, which every executor must reach. Returns (file, packets).
    A repeated task writes the same bytes again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        sink, current, count = None, None, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != current:
                    if sink is not None:
                        sink.close()
                        done.append((current, count))
                    current, count = row["file"], 0
                    sink = store.open_output_stream(f"{root}/{current}")
                    sink.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
                size = len(row["raw"])
                sink.write(struct.pack("<IIII", *divmod(row["ts_us"], 1_000_000), size, size) + row["raw"])
                count += 1
        if sink is not None:
            sink.close()
            done.append((current, count))
        names, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "packets"])

    block = F.floor(F.col("packet_id") / packets_per_file).cast("string")
    return (
        frames.select(F.concat("capture_id", F.lit("-"), block, F.lit(".pcap")).alias("file"), "packet_id", "ts_us", "raw")
        .repartition("file").sortWithinPartitions("file", "packet_id")
        .mapInArrow(write, "file string, packets bigint")
    )
