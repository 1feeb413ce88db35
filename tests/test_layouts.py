"""Stored layouts: what their plans read and move."""

import re

import pytest
from pyspark.sql import functions as F

from packetloom.plans import catalog as C
from packetloom.sources import layouts as L

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("layouts")
    flows = L.store(C.capture_flows(spark, FOLDER), str(at / "flows"), "start_time", "MINUTE")
    return flows, L.store(C.anomaly_table(spark, FOLDER), str(at / "anomalies"), "detected_at", "MINUTE"), at


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_bucket_of_a_period_is_one_file(tables):
    files = [str(f.relative_to(tables[2])) for f in (tables[2] / "flows").rglob("*.parquet")]
    places = [(f.split("/")[1], re.search(r"_(\d{5})\.", f)[1]) for f in files]
    assert len(places) == len(set(places)) > L.BUCKETS


def test_period_filter_reads_its_folders(spark, tables):
    df = L.in_period(spark, tables[0], "start_time", C.at_second(60), C.at_second(110), "MINUTE")
    assert re.search(r"PartitionFilters: \[[^\]]*period", plan(df))
    folders = lambda d: {f.rsplit("/", 2)[1] for f in d.inputFiles()}
    assert len(folders(df)) == 1 < len(folders(spark.table(tables[0])))
    assert df.select(F.input_file_name()).distinct().count() <= L.BUCKETS


def test_lookup_reads_one_bucket(spark, tables):
    flow_id = spark.table(tables[0]).first()["flow_id"]
    # The planner otherwise reads the same one bucket as plain files and does not name it.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        df = L.flow(spark, tables[0], flow_id)
        assert f"SelectedBucketsCount: 1 out of {L.BUCKETS}" in plan(df) and df.count() >= 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_report_moves_no_rows(spark, tables, no_broadcast):
    df = L.flow_report(spark, *tables[:2])
    text = plan(df)
    assert "SortMergeJoin" in text and "Exchange" not in text
    want = C.A.flow_anomaly_report(C.capture_flows(spark, FOLDER), C.anomaly_table(spark, FOLDER))
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


def test_the_same_flow_in_two_captures_stays_apart(spark, tmp_path, no_broadcast):
    both = [("a", "f"), ("b", "f"), ("b", "g")]
    flows = C.capture_flows(spark, FOLDER).limit(1)
    rows = spark.createDataFrame(both, "capture_id string, flow_id string")
    flows = flows.drop("capture_id", "flow_id").crossJoin(rows)
    found = C.anomaly_table(spark, FOLDER).limit(1).drop("capture_id", "flow_id", "severity").crossJoin(
        spark.createDataFrame([("a", "f", "low"), ("b", "f", "high")], "capture_id string, flow_id string, severity string"))
    a = L.store(flows, str(tmp_path / "f"), "start_time", buckets=4)
    b = L.store(found, str(tmp_path / "a"), "detected_at", buckets=4)
    assert sorted(map(tuple, L.flow_report(spark, a, b).select("flow_id", "severity").collect())) == [("f", "high"), ("f", "low"), ("g", "")]


def test_periods_are_found_while_the_query_runs(spark, tables):
    critical = spark.table(tables[1]).where("severity = 'critical'")
    df = L.in_periods_of(spark, tables[0], critical, "start_time", "MINUTE")
    assert "dynamicpruning" in plan(df).lower()
    assert "Exchange hashpartitioning(period" not in plan(df).split("dynamicpruning")[0]
    wanted = {r[0] for r in critical.select(F.date_trunc("MINUTE", "start_time")).distinct().collect()}
    assert {r[0] for r in df.select(F.date_trunc("MINUTE", "start_time")).distinct().collect()} == wanted
