"""Every registered query against its SQL, on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
# The training-data queries (opN_..., pipeline) have tests of their own.
QUERIES = {k: f for k, f in entry.queries().items() if not k.startswith("op") and k != "pipeline"}
ORACLE = {k: sql for k, sql in entry.oracle_sql().items() if k in QUERIES}
# These train models or are covered by test_detectors / test_stream at a smaller size.
SLOW = {"iforest_scores", "autoencoder_scores", "detector_pipeline", "anomaly_feed_stream"}
# Point lookups and rare rows may be empty on the smallest tables.
MAY_BE_EMPTY = {"flow_lookup", "anomaly_lookup", "packet_lookup", "anomalies_filter", "flows_page", "packets_page",
                "capture_filter", "anomalies_page", "flows_filter", "chunk_hosts", "http_hosts", "http_requests", "port_scan_default"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    from packetloom.plans.registry import oracle_sql

    assert set(oracle_sql()) <= set(QUERIES) | {"csv_report"}


def test_check_sql_needs_no_spark_files(monkeypatch, tmp_path):
    import pyspark

    monkeypatch.setattr(pyspark, "__path__", [str(tmp_path)])
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    problem = difference(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    if problem == "no rows to compare" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    sizes = [r["byte_count"] for r in rows]
    assert sizes == sorted(sizes, reverse=True)
