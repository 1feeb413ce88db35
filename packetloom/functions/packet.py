"""Expressions over packet fields: flow key, TCP flags, protocol label, display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag names in bit order.
TCP_FLAG_BITS = {
    "FIN": 0x01, "SYN": 0x02, "RST": 0x04, "PSH": 0x08,
    "ACK": 0x10, "URG": 0x20, "ECE": 0x40, "CWR": 0x80,
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def endpoint(ip: Column | str, port: Column | str, missing: str = "0") -> Column:
    return F.concat(col(ip), F.lit(":"), F.coalesce(col(port).cast("string"), F.lit(missing)))


def flow_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port",
             protocol="protocol") -> Column:
    """Direction-independent key: md5 over the two ordered endpoints and the label."""
    a, b = endpoint(src_ip, src_port), endpoint(dst_ip, dst_port)
    return F.md5(F.concat_ws("|", F.least(a, b), F.greatest(a, b), col(protocol)))


def tcp_flag_text(bits: Column | str) -> Column:
    return F.concat(*[
        F.when(col(bits).bitwiseAND(F.lit(bit)) != 0, F.lit(name)).otherwise(F.lit(""))
        for name, bit in TCP_FLAG_BITS.items()
    ])


def has_flag(name: str, flags: Column | str = "tcp_flags") -> Column:
    """Null-safe membership: a packet without flags has none of them."""
    return F.coalesce(F.upper(col(flags)).contains(name), F.lit(False))


def is_teardown(flags: Column | str = "tcp_flags") -> Column:
    return F.coalesce(col(flags).contains("FIN") | col(flags).contains("RST"), F.lit(False))


def protocol_label(is_arp: Column, ip_proto: Column, src_port: Column, dst_port: Column,
                   http_request: Column, dns_message: Column) -> Column:
    """First matching label wins; an HTTP request outranks port 443, DNS outranks UDP."""
    https = F.coalesce((src_port == 443) | (dst_port == 443), F.lit(False))
    return (
        F.when(is_arp, "ARP")
        .when((ip_proto == 6) & http_request, "HTTP")
        .when((ip_proto == 6) & https, "HTTPS")
        .when(ip_proto == 6, "TCP")
        .when((ip_proto == 17) & dns_message, "DNS")
        .when(ip_proto == 17, "UDP")
        .when(ip_proto == 1, "ICMP")
        .otherwise("OTHER")
    )


def info_text(dns_query="dns_query", http_host="http_host") -> Column:
    return F.coalesce(col(dns_query), col(http_host), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
