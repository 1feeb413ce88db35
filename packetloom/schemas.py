"""Row layouts of the stored tables."""

from __future__ import annotations

PACKET_COLUMNS = [
    "capture_id", "packet_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "length", "ttl", "tcp_flags", "payload_preview", "flow_id", "dns_query", "dns_response",
    "http_method", "http_host", "http_path", "arp_op", "arp_hwsrc", "arp_hwdst",
]

PACKET_DDL = (
    "capture_id string, packet_id bigint, timestamp timestamp, src_ip string, dst_ip string, "
    "src_port int, dst_port int, protocol string, length int, ttl int, tcp_flags string, "
    "payload_preview string, flow_id string, dns_query string, dns_response string, "
    "http_method string, http_host string, http_path string, "
    "arp_op string, arp_hwsrc string, arp_hwdst string"
)

FLOW_COLUMNS = [
    "capture_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "first_packet_id", "start_time", "end_time", "duration_seconds", "packet_count", "byte_count",
    "avg_packet_size", "min_packet_size", "max_packet_size",
    "tcp_syn_count", "tcp_fin_count", "tcp_rst_count", "tcp_ack_count", "tcp_psh_count",
    "packets_per_second", "bytes_per_second", "is_active", "close_reason",
]

CHUNK_COLUMNS = ["capture_id", "chunk_id", "category", "content", "metadata"]
