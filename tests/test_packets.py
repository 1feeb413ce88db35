import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.functions.dissect import dissect
from packetloom.functions.packet import flow_key, has_flag, is_teardown, protocol_label, tcp_flag_text
from packetloom.operators import filters as P
from packetloom.operators.flows import inter_arrival

ETH = bytes.fromhex("020000000002020000000001")


def ip(proto, payload, src="10.0.0.1", dst="10.0.0.2", options=b"", fragment=0, ttl=64):
    head = bytes([0x45 + len(options) // 4, 0]) + struct.pack(">HHHBBH", 20 + len(options) + len(payload), 0, fragment, ttl, proto, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + options + payload


def tcp(sport, dport, flags, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 65535, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def eth(kind, payload, tag=b""):
    return ETH + tag + struct.pack(">H", kind) + payload


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".")) + b"\0"


def dns(query, answers=()):
    head = struct.pack(">HHHHHH", 1, 0x8180, 1, len(answers), 0, 0)
    body = name(query) + struct.pack(">HH", 1, 1)
    for kind, data in answers:
        body += b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 60, len(data)) + data
    return head + body


@pytest.fixture(scope="module")
def dissected(spark):
    http = b"GET /index.html HTTP/1.1\r\nUser-Agent: x\r\nHost: example.org\r\n\r\nHost: body.example\r\n"
    arp = struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes.fromhex("0200000000aa0a0000010000000000000a000002")
    frames = {
        "syn": eth(0x0800, ip(6, tcp(1000, 22, 0x02))),
        "all_flags": eth(0x0800, ip(6, tcp(1000, 22, 0xFF))),
        "no_flags": eth(0x0800, ip(6, tcp(1000, 22, 0))),
        "https_by_source": eth(0x0800, ip(6, tcp(443, 5000, 0x10, b"\x01\x02"))),
        "http": eth(0x0800, ip(6, tcp(5000, 80, 0x18, http))),
        "http_443": eth(0x0800, ip(6, tcp(443, 8080, 0x18, b"POST /x HTTP/1.0\r\n\r\n"))),
        "http_other_port": eth(0x0800, ip(6, tcp(5000, 81, 0x18, http))),
        "http_response": eth(0x0800, ip(6, tcp(80, 5000, 0x18, b"HTTP/1.1 200 OK\r\n\r\n"))),
        "dns": eth(0x0800, ip(17, udp(5000, 53, dns("www.example.com")))),
        "dns_answer": eth(0x0800, ip(17, udp(53, 5000, dns("a.example.com", [(5, name("b.example.com")), (1, bytes([1, 2, 3, 4])),
                                                                         (28, bytes(15) + b"\x01")])))),
        "dns_broken": eth(0x0800, ip(17, udp(5000, 53, b"\0\0\0\0\0\x01\0\0\0\0\0\0\xc0\x0c"))),
        "udp": eth(0x0800, ip(17, udp(5000, 123, b"x"))),
        "icmp": eth(0x0800, ip(1, b"\x08\0\0\0\0\0\0\0")),
        "other": eth(0x0800, ip(47, b"\0" * 8)),
        "options": eth(0x0800, ip(6, tcp(1000, 22, 0x12), options=b"\x01" * 8)),
        "fragment": eth(0x0800, ip(6, tcp(1000, 22, 0x12), fragment=5)),
        "vlan": eth(0x0800, ip(17, udp(1, 2)), tag=b"\x81\x00\x00\x05"),
        "arp": eth(0x0806, arp),
        "ipv6": eth(0x86DD, b"\x60" + bytes(39)),
        "short": b"\x00" * 10,
        "cut_tcp": eth(0x0800, ip(6, b"\x01\x02\x03")),
    }
    rows = [(n, i, 1_700_000_000_123_456 + i, len(f), 1, f, None) for i, (n, f) in enumerate(frames.items())]
    rows.append(("raw_ip", 99, 0, 28, 101, ip(17, udp(7, 8)), None))
    rows.append(("broken_file", None, None, None, None, None, "not a capture file"))
    df = spark.createDataFrame(
        rows, "capture_id string, packet_id bigint, ts_us bigint, caplen int, link_type int, raw binary, error string")
    return {r["capture_id"]: r for r in dissect(df).collect()}


def test_labels(dissected):
    want = {"syn": "TCP", "https_by_source": "HTTPS", "http": "HTTP", "http_443": "HTTP", "http_other_port": "TCP",
            "http_response": "TCP", "dns": "DNS", "dns_answer": "DNS", "dns_broken": "UDP", "udp": "UDP", "icmp": "ICMP",
            "other": "OTHER", "options": "TCP", "fragment": "OTHER", "vlan": "UDP", "arp": "ARP", "raw_ip": "UDP", "cut_tcp": "OTHER"}
    assert {k: dissected[k]["protocol"] for k in want} == want
    assert not {"ipv6", "short", "broken_file"} & set(dissected)


def test_fields(dissected):
    assert dissected["syn"]["tcp_flags"] == "SYN" and dissected["no_flags"]["tcp_flags"] == ""
    assert dissected["all_flags"]["tcp_flags"] == "FINSYNRSTPSHACKURGECECWR"
    assert dissected["options"]["tcp_flags"] == "SYNACK" and dissected["options"]["dst_port"] == 22
    http = dissected["http"]
    assert (http["http_method"], http["http_path"], http["http_host"]) == ("GET", "/index.html", "example.org")
    assert dissected["http_443"]["http_host"] is None and dissected["http_443"]["http_method"] == "POST"
    assert dissected["https_by_source"]["payload_preview"] == "0102" and dissected["syn"]["payload_preview"] is None
    assert len(http["payload_preview"]) == 128
    assert dissected["dns"]["dns_query"] == "www.example.com" and dissected["dns"]["dns_response"] is None
    assert dissected["dns_answer"]["dns_response"] == "b.example.com,1.2.3.4,::1"
    arp = dissected["arp"]
    assert (arp["src_ip"], arp["dst_ip"], arp["arp_op"], arp["arp_hwsrc"]) == ("10.0.0.1", "10.0.0.2", "request", "02:00:00:00:00:aa")
    assert arp["ttl"] is None and dissected["syn"]["ttl"] == 64 and dissected["syn"]["length"] == 54
    assert dissected["icmp"]["src_port"] is None
    want = hashlib.md5(b"10.0.0.1:1000|10.0.0.2:22|TCP").hexdigest()
    assert dissected["syn"]["flow_id"] == want


def test_flow_key_direction_and_protocol(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", 1000, "10.0.0.2", 80, "TCP"), ("10.0.0.2", 80, "10.0.0.1", 1000, "TCP"),
         ("10.0.0.1", 1000, "10.0.0.2", 80, "UDP"), ("10.0.0.1", None, "10.0.0.2", None, "ICMP")],
        "src_ip string, src_port int, dst_ip string, dst_port int, protocol string")
    a, b, c, d = [r[0] for r in df.select(flow_key()).collect()]
    assert a == b != c
    assert d == hashlib.md5(b"10.0.0.1:0|10.0.0.2:0|ICMP").hexdigest()


def test_flags(spark):
    df = spark.createDataFrame([(0x02, "SYN"), (0x12, "SYNACK"), (0x04, None), (0x11, "FINACK")], "bits int, tcp_flags string")
    rows = df.select(tcp_flag_text("bits"), has_flag("ACK"), is_teardown()).collect()
    assert [tuple(r) for r in rows] == [("SYN", False, False), ("SYNACK", True, False), ("RST", False, False), ("FINACK", True, True)]


def test_label_order(spark):
    lit = F.lit
    label = protocol_label(lit(False), lit(6), lit(443), lit(80), lit(True), lit(False))
    other = protocol_label(lit(False), lit(255), lit(None).cast("int"), lit(None).cast("int"), lit(False), lit(False))
    assert tuple(spark.range(1).select(label, other).first()) == ("HTTP", "OTHER")


def test_capture_filter(make_packets):
    df = make_packets([
        {"protocol": "TCP"}, {"protocol": "HTTP"}, {"protocol": "HTTPS", "src_ip": "9.9.9.9"}, {"protocol": "UDP"},
        {"protocol": "DNS", "dst_port": 53}, {"protocol": "ICMP", "src_port": None}, {"protocol": "ARP"}, {"protocol": "OTHER"}])
    ids = lambda spec: [r[0] for r in P.capture_filter(df, spec).orderBy("packet_id").select("packet_id").collect()]
    assert ids(None) == [0, 1, 2, 3, 4, 5, 6]
    assert ids(P.CaptureFilter()) == list(range(8))
    assert ids(P.CaptureFilter(protocols=["tcp", "arp"])) == [0, 1, 2, 6]
    assert ids(P.CaptureFilter(protocols=["TCP"], src_ips=["9.9.9.9"])) == [2]
    assert ids(P.CaptureFilter(dst_ports=[53])) == [4]


def test_filters_and_pages(make_packets):
    df = make_packets([{"us": i // 2, "protocol": "TCP" if i % 2 else "UDP"} for i in range(10)])
    assert P.filter_packets(df, protocol="tcp").count() == 5
    got = [r["packet_id"] for r in P.page(df, "packets", "timestamp", ["packet_id"], limit=3, offset=1).collect()]
    assert got == [9, 6, 7]
    with pytest.raises(ValueError):
        P.page(df, "flows", "timestamp", ["packet_id"], limit=501)
    assert P.live_text_filter(df, "UD").count() == 5 and P.live_text_filter(df, "10.0.0.3").count() == 0
    assert P.lookup(df, "packet_id", 77).count() == 0


def test_inter_arrival_over_slices(make_packets):
    df = make_packets([{"us": i * i * 1000, "packet_id": i * 7} for i in range(20)])
    rows = {s: [r[0] for r in inter_arrival(df, s).orderBy("packet_id").select("inter_arrival_time").collect()] for s in (1, 10, 10**6)}
    assert rows[1] == rows[10] == rows[10**6]
    assert rows[1][0] is None and rows[1][3] == pytest.approx(0.005)
