import json
import os
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows as FL
from packetloom.plans.catalog import packets as event_packets
from packetloom.schemas import PACKET_DDL
from packetloom.streaming import feeds as FD
from packetloom.streaming import flows as SF
from tests.conftest import T0
from tests.test_flows import SECOND, random_packets


@pytest.fixture
def land(spark, tmp_path):
    """Write packet files one by one with rising file times; gives (folder, add)."""
    folder = tmp_path / "in"
    folder.mkdir()
    count = [0]

    def add(df):
        n = count[0]
        count[0] += 1
        df.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        source = next((tmp_path / f"part{n}").glob("*.parquet"))
        target = folder / f"{n:04d}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))

    return str(folder), add


def stream(spark, folder, per_trigger=1):
    return FD.stream_table(spark, folder, spark.createDataFrame([], PACKET_DDL).schema, files_per_trigger=per_trigger)


def sentinel(make_packets, seconds):
    return make_packets([{"us": seconds * SECOND, "packet_id": 10**6 + seconds, "src_ip": "1.1.1.1", "capture_id": "end"}])


def run(spark, df, tmp_path, name="out"):
    q = FD.write_batches(df, str(tmp_path / name), str(tmp_path / f"{name}-cp"))
    q.awaitTermination()
    return FD.read_batches(spark, str(tmp_path / name), df.schema), q


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_on_disordered_input(spark, make_packets, land, tmp_path, seed):
    rows = random_packets(seed, 250)
    for i, r in enumerate(rows):
        r["packet_id"] = i
    # Disorder within 20 s, less than the watermark delay.
    rng = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r["us"] + rng.randrange(20 * SECOND))
    folder, add = land
    for i in range(0, 250, 50):
        add(make_packets(arrival[i:i + 50]))
    last = max(r["us"] for r in rows) // SECOND
    add(sentinel(make_packets, last + 3600))
    add(sentinel(make_packets, last + 7200))
    got, _ = run(spark, SF.live_flow_stream(stream(spark, folder)), tmp_path)
    want = FL.close_at(FL.live_flows(make_packets(rows)), T0 + (last + 3600) * SECOND)
    pick = lambda df: sorted(map(tuple, df.where("capture_id = 'c'").collect()), key=str)
    assert pick(got) == pick(want) and len(pick(want)) > 20


def test_late_packets_are_counted(spark, make_packets, land, tmp_path):
    folder, add = land
    add(make_packets([{"us": 0}, {"us": 1000 * SECOND, "src_port": 1}]))
    add(make_packets([{"us": 1001 * SECOND, "src_port": 1, "packet_id": 5}]))
    add(make_packets([{"us": 10 * SECOND, "src_port": 9, "packet_id": 6}]))
    out, q = run(spark, SF.live_flow_stream(FD.observed(stream(spark, folder))), tmp_path)
    counters = FD.capture_counters(q)
    # The two packets that wait share one list; with its entry among the waiting slots that is two rows of state.
    assert counters["total_captured"] == 4 and counters["total_dropped"] == 1 and counters["queue_size"] == 2
    assert out.count() == 1


def test_counters_sum_more_batches_than_a_query_remembers(spark, make_packets, land, tmp_path):
    folder, add = land
    for i in range(7):
        add(make_packets([{"us": (1000 - 100 * i) * SECOND, "packet_id": i, "src_port": i}, {"us": 1000 * SECOND, "packet_id": 10 + i, "src_port": 99}]))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        _, q = run(spark, SF.live_flow_stream(FD.observed(stream(spark, folder))), tmp_path)
        counters = FD.capture_counters(q)
        assert len(q.recentProgress) <= 2
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    # Rows are late by the watermark of the batch before, so the second batch drops none yet.
    assert counters["total_captured"] == 14 and counters["total_dropped"] == 5


def test_feeds(spark, make_packets, land, tmp_path):
    folder, add = land
    add(make_packets([{"dns_query": "a.com", "protocol": "DNS", "us": 5}]))
    out, _ = run(spark, FD.packet_feed(stream(spark, folder)), tmp_path)
    event = json.loads(out.first()["value"])
    assert event["type"] == "packet" and len(event["data"]) == 11
    assert event["data"]["timestamp"] == "2024-01-01T00:00:00.000005+00:00" and event["data"]["http_host"] is None


def test_counters_per_minute_and_idle_flows(spark, make_packets, land, tmp_path):
    folder, add = land
    add(make_packets([{"us": 10 * SECOND}, {"us": 50 * SECOND}, {"us": 70 * SECOND}, {"us": 500 * SECOND}]))
    minutes, _ = run(spark, FD.protocol_minutes(stream(spark, folder)), tmp_path, "m")
    assert sorted(r["packets"] for r in minutes.collect()) == [1, 2]
    idle, _ = run(spark, FD.idle_flows(stream(spark, folder)), tmp_path, "i")
    assert [r["packet_count"] for r in idle.collect()] == [3]


def test_latest_rows(spark, make_packets, land, tmp_path):
    folder, add = land
    for i in range(3):
        add(make_packets([{"us": (i * 4 + j) * SECOND, "packet_id": i * 4 + j} for j in range(4)]))
    FD.keep_latest(stream(spark, folder), str(tmp_path / "top"), str(tmp_path / "cp"), "timestamp", "packet_id", 5).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "top" / "batch=2")).select("packet_id").collect()
    assert sorted(r[0] for r in kept) == [7, 8, 9, 10, 11]


def test_repeated_batch_replaces_itself(spark, make_packets, tmp_path):
    df = make_packets([{}, {}])
    for _ in range(2):
        df.write.mode("overwrite").parquet(str(tmp_path / "t" / "batch=0"))
    assert FD.read_batches(spark, str(tmp_path / "t"), df.schema).count() == 2


def test_adapter_is_the_same_in_batch_and_stream(spark):
    from packetloom.plans.catalog import packet_stream

    folder = "/root/testdata/sf0.001"
    assert packet_stream(spark, folder).schema == event_packets(spark, folder).schema
    assert event_packets(spark, folder).select(F.countDistinct("flow_id")).first()[0] > 100


def test_groups_of_flows_are_folded_at_once(spark, make_packets):
    """One call adds the packets of many flows, in parts of time, like a pass over all packets at once."""
    rows = [{**r, "packet_id": i, "capture_id": f"c{i % 3}"} for i, r in enumerate(random_packets(7, 400))]
    marked = make_packets(rows).select("capture_id", "flow_id", F.unix_micros("timestamp").alias("us"), "packet_id", "length", F.when(
        F.col("tcp_flags").rlike("FIN|RST"), SF._CLOSES).otherwise(0).alias("marks"), "src_ip", "dst_ip", *[F.coalesce(c, F.lit(-1)).alias(c) for c in SF._PORTS], "protocol")
    packets = marked.toPandas()
    slots = packets["us"] // (50 * SECOND)
    flows, found = None, []
    for s in sorted(set(slots)):
        closed, flows = SF.fold(flows, packets[slots == s], 120 * SECOND)
        found.append(closed)
    found = [r for f in [*found, flows] for r in f[["capture_id", "flow_id", "first_us", "last_us", "first_packet_id", "packet_count", "byte_count", "teardown"]].values.tolist()]
    want = FL.live_flows(make_packets(rows)).select("capture_id", "flow_id", "first_us", "last_us", F.col("_head.first_packet_id"), "packet_count", "byte_count", "closed")
    assert sorted(map(str, found)) == sorted(str(list(r)) for r in want.collect()) and len(found) > 20
