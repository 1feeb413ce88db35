"""Served numbers against plain counting, also when a driver is lost between two merges."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetloom.sources.merge_table import MergeTable, largest_row
from packetloom.streaming import dashboard as DB
from packetloom.streaming import late as LT


def table_of(spark, path, ddl, keys, buckets=4):
    return MergeTable(spark, str(path), spark.createDataFrame([], ddl).schema, keys, buckets)


@pytest.mark.parametrize("seed,capacity,n", [(1, 4, 2), (2, 3, 3), (3, 50, 5)])
def test_talkers(spark, make_packets, tmp_path, seed, capacity, n):
    rnd = random.Random(seed)
    rows = [{"capture_id": rnd.choice("ab"), "src_ip": f"10.0.0.{min(int(rnd.expovariate(0.4)), 30)}", "length": rnd.randrange(1, 1500)} for _ in range(300)]
    rows += [{"capture_id": "c", "src_ip": f"10.1.0.{i % 9}", "length": 100} for i in range(90)]  # all alike: nothing outweighs the bound
    rows += [{"capture_id": "a", "src_ip": None, "length": 5000}]
    rnd.shuffle(rows)
    packets = make_packets(rows)
    summary = table_of(spark, tmp_path / "t", DB.TALKERS_DDL, ["capture_id"])
    save = DB.talkers_sink(summary, "p", capacity)
    for i in range(4):
        save(packets.where(F.col("packet_id") % 4 == i), i)
        save(packets.where(F.col("packet_id") % 4 == i), i)  # delivered again
    truth = Counter()
    for r in rows:
        if r["src_ip"]:
            truth[r["capture_id"], r["src_ip"]] += r["length"]
    found = summary.read().collect()
    assert max(Counter(r["capture_id"] for r in found if r["ip"]).values()) <= capacity
    for r in found:
        if r["ip"]:
            assert r["weight"] <= truth[r["capture_id"], r["ip"]] <= r["weight"] + r["missed"]
    for capture in "abc":
        want = sorted(((-w, ip) for (c, ip), w in truth.items() if c == capture))[:n]
        got = DB.top_talkers(summary.read(), packets, n).where(F.col("capture_id") == capture).orderBy("rank").collect()
        assert [(-r["bytes"], r["ip"]) for r in got] == want
    bounds = DB.talker_bounds(summary.read(), packets).collect()
    assert len(bounds) == 3 and all(r["enclosed"] and r["complete"] for r in bounds)


DDL = "flow string, state string, at long"


def test_a_view_takes_back_what_changed(spark, tmp_path, monkeypatch):
    current = table_of(spark, tmp_path / "c", DDL, ["flow"])
    view = table_of(spark, tmp_path / "v", "state string, flows bigint", ["state"])
    save = DB.view_sink(current, largest_row(["flow"], ["flow", "state", "at"], ["at"]), view, ["flows"], "s",
                        lambda rows: rows.select("state", F.lit(1).cast("bigint").alias("flows")))
    served = lambda: {r["state"]: r["flows"] for r in view.read().where("flows <> 0").collect()}
    batch = lambda *rows: spark.createDataFrame(list(rows), DDL)
    save(batch(("a", "ok", 1), ("b", "ok", 1), ("c", "bad", 1), ("c", "ok", 0)), 0)
    assert served() == {"ok": 2, "bad": 1}
    change = batch(("a", "bad", 2), ("b", "worse", 0), ("d", None, 1))
    with monkeypatch.context() as m:  # the view is merged, the table is not
        whole = MergeTable.upsert

        def lost(self, *args):
            if self is current:
                raise RuntimeError("driver lost")
            return whole(self, *args)

        m.setattr(MergeTable, "upsert", lost)
        with pytest.raises(RuntimeError):
            save(change, 1)
    for _ in range(2):
        save(change, 1)
        assert served() == {"ok": 1, "bad": 2, None: 1}
    assert current.read().count() == 4


def test_totals_grow_by_batches(spark, make_packets, tmp_path):
    totals = table_of(spark, tmp_path / "t", DB.TOTALS_DDL, DB.TOTALS_KEY)
    save = DB.totals_sink(totals, "p")
    packets = make_packets([{"us": i, "protocol": "TCP" if i % 3 else "UDP", "length": 10} for i in range(9)])
    for i in range(3):
        save(packets.where(F.col("packet_id") % 3 == i), i)
        seen = packets.where(F.col("packet_id") % 3 <= i)
        got = {r["protocol"]: (r["packets"], r["bytes"], round(r["share"], 6)) for r in DB.served_totals(totals.read()).collect()}
        n = seen.count()
        assert got == {r["protocol"]: (r["count"], 10 * r["count"], round(r["count"] / n, 6)) for r in seen.groupBy("protocol").count().collect()}


def test_late_rows_are_kept_aside(spark, make_packets, tmp_path):
    save = LT.split_sink(str(tmp_path), "timestamp", 30)
    second = 1_000_000
    batches = [[0, 100], [90, 71, 70, 69, 10], [], [200], [171, 170, 169, 300], [269]]
    for i, times in enumerate(batches):
        df = make_packets([{"us": t * second, "packet_id": t} for t in times]).select("packet_id", "timestamp")
        for _ in range(2 if i % 2 else 1):
            save(df, i)
    ddl = "packet_id bigint, timestamp timestamp"
    late = {(r["packet_id"], r["batch"], r["delay_us"] // second) for r in LT.late(spark, str(tmp_path), ddl).collect()}
    assert late == {(70, 1, 0), (69, 1, 1), (10, 1, 60), (170, 4, 0), (169, 4, 1), (269, 5, 1)}
    assert LT.accepted(spark, str(tmp_path), ddl).count() + len(late) == sum(map(len, batches))
