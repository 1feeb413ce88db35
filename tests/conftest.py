import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from packetloom.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
                            spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
                            spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


PACKET_DEFAULTS = {
    "capture_id": "c", "packet_id": 0, "us": 0, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 12345,
    "dst_port": 80, "protocol": "TCP", "length": 100, "ttl": 64, "tcp_flags": None, "payload_preview": None,
    "dns_query": None, "dns_response": None, "http_method": None, "http_host": None, "http_path": None,
    "arp_op": None, "arp_hwsrc": None, "arp_hwdst": None,
}
T0 = 1_704_067_200_000_000


@pytest.fixture(scope="session")
def make_packets(spark):
    """Packet table from dicts; ``us`` is microseconds after 2024-01-01, ids follow the list order."""
    from pyspark.sql import functions as F

    from packetloom.functions.packet import flow_key
    from packetloom.schemas import PACKET_COLUMNS

    ddl = ("capture_id string, packet_id bigint, us bigint, src_ip string, dst_ip string, src_port int, dst_port int, "
           "protocol string, length int, ttl int, tcp_flags string, payload_preview string, dns_query string, "
           "dns_response string, http_method string, http_host string, http_path string, arp_op string, "
           "arp_hwsrc string, arp_hwdst string")

    def make(rows):
        full = [{**PACKET_DEFAULTS, "packet_id": i, **r} for i, r in enumerate(rows)]
        df = spark.createDataFrame([tuple(r[c] for c in PACKET_DEFAULTS) for r in full], ddl)
        return df.withColumn("timestamp", F.timestamp_micros(F.lit(T0) + F.col("us"))).withColumn(
            "flow_id", flow_key()).select(*PACKET_COLUMNS)

    return make


FLOW_DEFAULTS = {
    "capture_id": "c", "flow_id": "abc123", "src_ip": "192.168.1.1", "dst_ip": "8.8.8.8", "src_port": 12345, "dst_port": 443,
    "protocol": "TCP", "first_packet_id": 0, "packet_count": 100, "byte_count": 150000, "duration_seconds": 10.0,
    "avg_packet_size": 1500.0, "packets_per_second": 10.0, "bytes_per_second": 15000.0, "tcp_syn_count": 1,
    "tcp_fin_count": 1, "tcp_rst_count": 0, "tcp_ack_count": 98, "tcp_psh_count": 50, "is_anomaly": False,
    "anomaly_type": None, "severity": "info", "ensemble_score": 0.1,
}
FLOW_DDL = ("capture_id string, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
            "first_packet_id bigint, packet_count bigint, byte_count bigint, duration_seconds double, avg_packet_size double, "
            "packets_per_second double, bytes_per_second double, tcp_syn_count bigint, tcp_fin_count bigint, tcp_rst_count bigint, "
            "tcp_ack_count bigint, tcp_psh_count bigint, is_anomaly boolean, anomaly_type string, severity string, ensemble_score double")


@pytest.fixture(scope="session")
def make_flows(spark):
    def make(rows):
        full = [{**FLOW_DEFAULTS, "flow_id": f"f{i:03d}", "first_packet_id": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in FLOW_DEFAULTS) for r in full], FLOW_DDL)

    return make
