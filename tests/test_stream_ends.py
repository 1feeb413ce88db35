"""Stream queries return the whole input: what is still open at the last row is closed by the mark behind it."""

import pytest
from pyspark.sql import functions as F

from packetloom.plans.registry import QUERIES, oracle_sql
from packetloom.streaming import feeds as FD
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["protocol_minutes_stream", "session_windows_stream", "idle_flows_stream", "live_flows_stream"])
def test_nothing_open_is_left_out(spark, name):
    assert difference(spark, duck(FOLDER), QUERIES[name], oracle_sql()[name], FOLDER) is None
    count = {"protocol_minutes_stream": "packets", "live_flows_stream": "packet_count", "idle_flows_stream": "packet_count"}.get(name, "message_count")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert duck(FOLDER).execute(f"SELECT sum({count}) FROM ({oracle_sql()[name]})").fetchone()[0] == events


def test_the_mark_is_one_row_behind_all_others(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    mark = FD.end_mark(events)
    assert mark.schema == events.schema and mark.count() == 1 and FD.end_mark(events.limit(0)).count() == 0
    assert (mark.first()["ts"] - events.agg(F.max("ts")).first()[0]).days == 365
