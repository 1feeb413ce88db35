import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from packetloom.operators import reports as R
from packetloom.operators.anomalies import REPORT_FIELDS, merge_live
from packetloom.operators.flows import capture_flows
from packetloom.plans import fixtures as X
from tests.conftest import T0

AT = lambda s: datetime.fromtimestamp(T0 / 1e6 + s, timezone.utc)


@pytest.fixture(scope="module")
def tables(make_packets):
    packets = make_packets([{"us": i * 1_000_000, "src_port": 1000 + i % 8, "length": 100 + 37 * i, "src_ip": f"10.0.0.{i % 3}"}
                            for i in range(60)]).cache()
    flows = capture_flows(packets).cache()
    return packets, flows, X.anomaly_table(X.scored_flows(flows)).cache()


def test_csv(spark, tables, tmp_path):
    row = R.generate_report(spark, "r", "csv", str(tmp_path), *tables).first()
    read = spark.read.option("header", True).csv(row["file_path"])
    assert read.columns == REPORT_FIELDS and read.count() == tables[1].count() == row["flow_count"]
    assert row["packet_count"] == 60 and row["anomaly_count"] == tables[2].where("is_anomaly").count()


def test_json_with_period(spark, tables, tmp_path):
    row = R.generate_report(spark, "r", "json", str(tmp_path), *tables, start=AT(10), end=AT(19)).first()
    doc = json.loads("\n".join(r["value"] for r in spark.read.text(f"{row['file_path']}/summary", wholetext=True).collect()))
    assert doc["summary"]["packet_count"] == 10 and doc["period"]["start"] == AT(10).isoformat()
    assert sum(doc["protocol_breakdown"].values()) == 10 and [t["packets"] for t in doc["top_talkers"]] == [4, 3, 3]
    assert row["period_end"] is not None


def test_json_lists_every_anomaly(spark, tables, tmp_path):
    row = R.generate_report(spark, "r", "json", str(tmp_path), *tables).first()
    assert spark.read.json(f"{row['file_path']}/anomalies").count() == row["anomaly_count"] > 0


def test_pdf_tables(spark, tables, tmp_path):
    row = R.generate_report(spark, "r", "pdf", str(tmp_path), *tables).first()
    summary = dict(spark.read.parquet(f"{row['file_path']}/summary").collect())
    assert list(sorted(summary)) == ["Anomalies Detected", "Anomaly Rate", "Total Flows", "Total Packets"]
    none = [t.where("false") for t in tables]
    assert dict(R.report_summary(*none).collect())["Anomaly Rate"] == "N/A"
    tops = spark.read.parquet(f"{row['file_path']}/top_anomalies").collect()
    assert all(len(r["flow_id"]) == 21 and len(r["explanation"]) in (0, 81) for r in tops)


def test_registry(spark, tables, tmp_path):
    for i in range(3):
        R.generate_report(spark, f"r{i}", "pdf", str(tmp_path), *tables, created_at=AT(i))
    assert [r["name"] for r in R.list_reports(spark, str(tmp_path), 2).collect()] == ["r2", "r1"]
    with pytest.raises(ValueError):
        R.generate_report(spark, "r", "xml", str(tmp_path), *tables)


def test_live_rows_come_first(spark):
    ddl = "anomaly_id string, flow_id string, position int"
    live = spark.createDataFrame([("b", "live", 1), ("a", "live", 2)], ddl)
    stored = spark.createDataFrame([("c", "old", 1), ("b", "old", 2)], ddl)
    assert [(r["anomaly_id"], r["flow_id"], r["origin"]) for r in merge_live(live, stored).collect()] == [
        ("b", "live", "live"), ("a", "live", "live"), ("c", "old", "stored")]
