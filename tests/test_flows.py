import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows as FL
from packetloom.operators import stats as S
from packetloom.operators.segments import pieces, session_gaps
from tests.conftest import T0

SECOND = 1_000_000


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_counts_and_rates(make_packets):
    p = make_packets([{"length": 100, "tcp_flags": "SYN"}, {"length": 1400, "tcp_flags": "SYNACK", "us": SECOND},
                      {"length": 500, "tcp_flags": "RST", "us": 2 * SECOND}])
    f = one(FL.capture_flows(p))
    assert (f["packet_count"], f["byte_count"], f["min_packet_size"], f["max_packet_size"]) == (3, 2000, 100, 1400)
    assert (f["tcp_syn_count"], f["tcp_rst_count"], f["tcp_ack_count"], f["tcp_fin_count"]) == (2, 1, 1, 0)
    assert f["duration_seconds"] == 2.0 and f["packets_per_second"] == 1.5 and f["bytes_per_second"] == 1000.0
    assert f["close_reason"] == "teardown" and f["first_packet_id"] == 0


def test_zero_duration_has_no_rate(make_packets):
    f = one(FL.capture_flows(make_packets([{}, {}])))
    assert f["duration_seconds"] == 0.0 and f["packets_per_second"] is None and f["avg_packet_size"] == 100.0


def test_both_directions_one_flow(make_packets):
    f = one(FL.capture_flows(make_packets([
        {"src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 12345}, {"us": 5}])))
    assert f["src_ip"] == "10.0.0.2" and f["src_port"] == 80 and f["packet_count"] == 2


def test_teardown_freezes_rates_but_not_counts(make_packets):
    p = make_packets([{"length": 100}, {"length": 300, "tcp_flags": "FINACK", "us": 2 * SECOND}, {"length": 1000, "us": 9 * SECOND}])
    f = one(FL.capture_flows(p))
    assert f["packet_count"] == 3 and f["byte_count"] == 1400 and f["max_packet_size"] == 1000
    assert f["duration_seconds"] == 2.0 and f["avg_packet_size"] == 200.0 and f["packets_per_second"] == 1.0


def test_gap_border_and_teardown(make_packets):
    p = make_packets([{"us": 0}, {"us": 120 * SECOND}, {"us": 240 * SECOND + 1}, {"us": 241 * SECOND, "tcp_flags": "RST"},
                      {"us": 241 * SECOND}, {"us": 242 * SECOND}])
    rows = FL.close_at(FL.live_flows(p), T0 + 300 * SECOND).orderBy("start_time", "first_packet_id").collect()
    assert [(r["first_packet_id"], r["packet_count"], r["close_reason"], r["is_active"]) for r in rows] == [
        (0, 2, "timeout", False), (2, 2, "teardown", False), (4, 2, "open", True)]


def random_packets(seed, n=400):
    rng, us, rows = random.Random(seed), 0, []
    for _ in range(n):
        us += rng.choice([0, 0, 1, SECOND, 20 * SECOND, 60 * SECOND, 130 * SECOND])
        hot = rng.random() < 0.6  # one flow holds most rows
        rows.append({"us": us, "length": rng.randrange(60, 1500), "src_port": 1000 if hot else rng.randrange(1001, 1006),
                     "tcp_flags": rng.choice(["ACK", "ACK", "ACK", "SYN", "FINACK", "RST", None])})
    return rows


def expected_segments(rows, gap=120 * SECOND):
    """Plain loop over the packets in time order."""
    done, current = [], {}
    for i, r in enumerate(rows):
        key = r["src_port"]
        seg = current.get(key)
        if seg is None or seg["closed"] or r["us"] - seg["last"] > gap:
            seg = current[key] = {"first": i, "n": 0, "bytes": 0, "closed": False, "start": r["us"]}
            done.append(seg)
        seg["n"] += 1
        seg["bytes"] += r["length"]
        seg["last"] = r["us"]
        seg["closed"] = bool(r["tcp_flags"]) and ("FIN" in r["tcp_flags"] or "RST" in r["tcp_flags"])
    return sorted((s["first"], s["n"], s["bytes"], s["start"], s["last"], s["closed"]) for s in done)


@pytest.mark.parametrize("rows_per_task", [1, 7, 60, 10_000_000])
def test_segments_equal_a_plain_loop(make_packets, rows_per_task):
    rows = random_packets(rows_per_task)
    shuffled = make_packets(rows).orderBy(F.rand(7)).repartition(5)
    got = FL.live_flows(shuffled, rows_per_task=rows_per_task).select(
        "first_packet_id", "packet_count", "byte_count", F.col("first_us") - T0, F.col("last_us") - T0, "closed").collect()
    assert sorted(tuple(r) for r in got) == expected_segments(rows)


def test_capture_flows_do_not_depend_on_slices_or_order(make_packets):
    p = make_packets(random_packets(3))
    results = [sorted(map(tuple, FL.capture_flows(df, n).collect()), key=str)
               for df, n in ((p, 1), (p, 7), (p, 10**9), (p.orderBy(F.rand(1)).repartition(6), 7))]
    assert all(r == results[0] for r in results)


def test_sessions(spark):
    rows = [("a", 1, 0), ("a", 2, 3600), ("a", 3, 7201), ("b", 4, 10)]
    df = spark.createDataFrame([(u, i, s * SECOND) for u, i, s in rows], "user_id string, event_id bigint, us bigint")
    for rows_per_task in (1, 2, 10**6):
        got = sorted((r["user_id"], r["first_us"] // SECOND, r["last_us"] // SECOND, r["events"])
                     for r in session_gaps(df, "user_id", "us", "event_id", rows_per_task=rows_per_task).collect())
        assert got == [("a", 0, 3600, 2), ("a", 7201, 7201, 1), ("b", 10, 10, 1)]


def test_a_hot_key_is_cut_into_bounded_pieces(spark):
    """One key (once a null one) with 90 % of the rows, most of them within one second."""
    rng = random.Random(4)
    times = [rng.randrange(SECOND) if i % 10 else rng.randrange(10**5) * SECOND for i in range(20_000)]
    for hot in ("hot", None):
        rows = [(hot if i % 10 < 9 else f"k{i % 90}", i, t) for i, t in enumerate(times)]
        df = spark.createDataFrame(rows, "user_id string, event_id bigint, us bigint").repartition(6)
        cut = pieces(df, ["user_id"], "us", 1000)
        sizes = cut.groupBy("user_id", "_piece").count().collect()
        assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) <= 1000
        assert sum(r["user_id"] == hot for r in sizes) >= 18
        order = cut.where(F.col("user_id").eqNullSafe(hot)).groupBy("_piece").agg(F.min("us"), F.max("us")).orderBy("_piece").collect()
        assert all(a[2] < b[1] for a, b in zip(order, order[1:]))
        whole, small = (sorted(map(tuple, session_gaps(df, "user_id", "us", "event_id", 60, n).collect()), key=str) for n in (10**9, 1000))
        assert whole == small and len(whole) > 500
    assert pieces(df, ["user_id"], "us", 10**6) is None


@pytest.mark.parametrize("ports,found", [(9, 0), (10, 1), (12, 1)])
def test_port_scan_border(make_flows, ports, found):
    flows = make_flows([{"dst_port": i + 1} for i in range(ports)] + [{"dst_port": 500, "tcp_syn_count": 0}]
                       + [{"dst_port": 600, "protocol": "UDP"}, {"dst_port": 1}])
    rows = FL.port_scanners(flows).collect()
    assert len(rows) == found
    if found:
        assert rows[0]["ports"] == list(range(1, ports + 1)) and rows[0]["port_count"] == ports


def test_tcp_health_borders(make_flows):
    flows = make_flows([
        {"tcp_ack_count": 0}, {"tcp_ack_count": 0, "tcp_syn_count": 0}, {"tcp_rst_count": 5}, {"tcp_rst_count": 6},
        {"packet_count": 10, "avg_packet_size": 79.0, "tcp_ack_count": 9}, {"packet_count": 11, "avg_packet_size": 79.0, "tcp_ack_count": 9},
        {"packet_count": 11, "avg_packet_size": 80.0, "tcp_ack_count": 9}, {"packet_count": 20, "avg_packet_size": 70.0, "tcp_ack_count": 12},
        {"packet_count": 20, "avg_packet_size": 70.0, "tcp_ack_count": 13}, {"protocol": "UDP", "tcp_ack_count": 0}])
    r = one(FL.tcp_health(flows))
    assert (r["tcp_flow_count"], r["incomplete_handshakes"], r["rst_storms"], r["retransmission_hints"]) == (9, 1, 1, 2)


def test_totals_of_nothing(make_packets, make_flows, spark):
    none = make_packets([{}]).where("false")
    r = one(S.traffic_totals(none, make_flows([{}]).where("false"), make_flows([{}]).where("false")))
    assert (r["total_packets"], r["total_bytes"], r["total_flows"], r["anomaly_rate"]) == (0, 0, 0, 0.0)
    assert r["capture_duration_seconds"] is None


def test_talkers_break_ties_by_address(make_packets):
    p = make_packets([{"src_ip": f"10.0.0.{9 - i}", "length": 100} for i in range(5)])
    assert [r["ip"] for r in S.top_talkers_by_packets(p, 3).collect()] == ["10.0.0.5", "10.0.0.6", "10.0.0.7"]
    ranked = S.top_talkers_by_bytes(p, 2).orderBy("rank").collect()
    assert [r["ip"] for r in ranked] == ["10.0.0.5", "10.0.0.6"]


def test_live_sessions(spark):
    roll = S.session_rollup(spark.createDataFrame([("s", 0), ("s", 10), ("t", 5000)], "session_id string, s int").withColumn(
        "ts", F.timestamp_seconds("s")))
    assert {r["session_id"] for r in S.live_sessions(roll, F.timestamp_seconds(F.lit(3610))).collect()} == {"s", "t"}
    assert {r["session_id"] for r in S.live_sessions(roll, F.timestamp_seconds(F.lit(3611))).collect()} == {"t"}
