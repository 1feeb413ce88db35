import pytest
from pyspark.sql import functions as F

from packetloom.operators import anomalies as A


@pytest.mark.parametrize("score,flag,want", [
    (0.95, True, "critical"), (0.95 - 1e-9, True, "high"), (0.8, True, "high"), (0.8 - 1e-9, True, "medium"),
    (0.6, True, "medium"), (0.6 - 1e-9, True, "low"), (0.4, True, "low"), (0.4 - 1e-9, True, "info"), (0.99, False, "info")])
def test_severity(spark, score, flag, want):
    assert spark.range(1).select(A.severity(F.lit(score), F.lit(flag))).first()[0] == want


CASES = [
    ({"tcp_syn_count": 21, "tcp_ack_count": 4, "duration_seconds": 4.9}, "port_scan"),
    ({"tcp_syn_count": 20, "tcp_ack_count": 4, "duration_seconds": 4.9}, "unknown"),
    ({"tcp_syn_count": 21, "tcp_ack_count": 5, "duration_seconds": 4.9}, "unknown"),
    ({"tcp_syn_count": 21, "tcp_ack_count": 4, "duration_seconds": 5.0}, "unknown"),
    ({"tcp_syn_count": 21, "tcp_ack_count": 4, "duration_seconds": None}, "port_scan"),
    ({"protocol": "DNS", "packet_count": 101}, "dns_spike"), ({"protocol": "DNS", "packet_count": 100}, "unknown"),
    ({"byte_count": 50_000_001}, "data_exfiltration"), ({"byte_count": 50_000_000}, "unknown"),
    ({"byte_count": 50_000_001, "protocol": "HTTPS"}, "data_exfiltration"), ({"byte_count": 50_000_001, "protocol": "HTTP"}, "unknown"),
    ({"tcp_rst_count": 51}, "rst_storm"), ({"tcp_rst_count": 50}, "unknown"),
    ({"packet_count": 501, "avg_packet_size": 99.9}, "slow_loris"), ({"packet_count": 500, "avg_packet_size": 99.9}, "unknown"),
    ({"packet_count": 501, "avg_packet_size": 100.0}, "unknown"), ({"packet_count": 501, "avg_packet_size": None}, "slow_loris"),
    ({"tcp_rst_count": 51, "byte_count": 50_000_001}, "data_exfiltration"),
]


def test_rules(make_flows):
    got = [r[0] for r in make_flows([c for c, _ in CASES]).orderBy("first_packet_id").select(A.rule_type()).collect()]
    assert got == [w for _, w in CASES]


def test_ensemble(spark, make_flows):
    base = make_flows([{}, {}, {}, {}]).drop("is_anomaly", "anomaly_type", "severity", "ensemble_score")
    scores = spark.createDataFrame(
        [("f000", 0.2, 0.6, False, True), ("f001", None, 0.7, None, False), ("f002", None, None, None, None), ("f003", 1.0, 1.0, True, True)],
        "flow_id string, a double, b double, fa boolean, fb boolean")
    rows = {r["flow_id"]: r for r in A.ensemble(base.join(scores, "flow_id"), ["a", "b"], ["fa", "fb"]).collect()}
    assert rows["f000"]["ensemble_score"] == pytest.approx(0.4) and rows["f000"]["severity"] == "low"
    assert rows["f001"]["ensemble_score"] == 0.7 and not rows["f001"]["is_anomaly"] and rows["f001"]["severity"] == "info"
    assert rows["f002"]["ensemble_score"] == 0.0 and rows["f002"]["anomaly_type"] is None
    assert rows["f003"]["severity"] == "critical" and rows["f003"]["anomaly_type"] == "unknown"
    one = scores.select("flow_id", F.col("a").alias("score"), F.col("fa").alias("is_anomaly")).where("score is not null")
    fused = {r["flow_id"]: r["ensemble_score"] for r in A.fuse_detectors(base, [one], ["flow_id"]).collect()}
    assert fused == {"f000": 0.2, "f001": 0.0, "f002": 0.0, "f003": 1.0}


def test_scaler(spark, make_flows):
    features = A.feature_vector(make_flows([{"packet_count": 1}, {"packet_count": 3}, {"packet_count": 5, "src_port": None}]))
    params = {r["feature"]: r for r in A.scaler_table(A.fit_scaler(features)).collect()}
    assert params["packet_count"]["mean"] == 3 and params["packet_count"]["scale"] == pytest.approx((8 / 3) ** 0.5)
    assert params["dst_port"]["scale"] == 1.0
    scaled = A.apply_scaler(features, A.fit_scaler(features))
    assert scaled.agg(F.sum("packet_count")).first()[0] == pytest.approx(0) and len(A.FEATURES) == 13
    assert A.apply_scaler(features, None) is features


def test_latest_anomaly_wins(spark, make_flows):
    flows = make_flows([{}, {}]).withColumn("start_time", F.timestamp_seconds(F.lit(0))).drop(
        "is_anomaly", "anomaly_type", "severity", "ensemble_score")
    anomalies = spark.createDataFrame(
        [("1", "c", "f000", 5, True, "rst_storm", 0.9, "high", None), ("2", "c", "f000", 9, False, None, 0.1, "info", "later")],
        "anomaly_id string, capture_id string, flow_id string, t int, is_anomaly boolean, anomaly_type string, ensemble_score double, "
        "severity string, explanation string").withColumn("detected_at", F.timestamp_seconds("t"))
    rows = {r["flow_id"]: r for r in A.flow_anomaly_report(flows, anomalies).collect()}
    assert len(A.REPORT_FIELDS) == 20 and list(rows["f000"].asDict()) == A.REPORT_FIELDS
    assert rows["f000"]["explanation"] == "later" and not rows["f000"]["is_anomaly"] and rows["f000"]["anomaly_type"] == ""
    assert rows["f001"]["severity"] == "" and rows["f001"]["anomaly_score"] is None and rows["f001"]["is_anomaly"] is False


def test_too_few_flows_train_nothing(make_flows):
    from packetloom.operators.detect import train

    assert train(make_flows([{}] * 9)) is None
    assert A.enough_to_train(make_flows([{}] * 10))
