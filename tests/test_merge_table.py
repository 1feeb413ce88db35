"""Keyed merges into stored tables: replays, untouched buckets, lost drivers, lookups."""

import pytest
from pyspark.sql import functions as F

from packetloom.plans import stored as ST
from packetloom.sources import merge_table as M
from tests.compare import difference, duck

DDL = "k string, n long, seen long, note string"


@pytest.fixture
def table(spark, tmp_path):
    return M.MergeTable(spark, str(tmp_path / "t"), spark.createDataFrame([], DDL).schema, ["k"], buckets=8)


def rules():
    return M.by_rules(["k"], {"n": F.sum("n"), "seen": F.max("seen"), "note": M.first_text("note")})


def rows(spark, *values):
    return spark.createDataFrame(list(values), DDL)


def stored(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_rows_are_merged_by_key(spark, table):
    merge = rules()
    assert stored(table) == []
    assert table.upsert(rows(spark, ("a", 1, 5, None), ("a", 1, 7, ""), ("b", 1, 1, "x"), (None, 1, 2, None)), merge)
    assert table.upsert(rows(spark, ("a", 2, 6, "late"), ("b", 1, 9, "y"), ("c", 1, 1, None), (None, 4, 1, "z")), merge)
    assert stored(table) == sorted([("a", 4, 7, "late"), ("b", 2, 9, "x"), ("c", 1, 1, None), (None, 5, 2, "z")], key=str)


def test_a_batch_counts_once_per_stream(spark, table):
    merge, batch = rules(), rows(spark, ("a", 1, 1, None))
    done = [table.upsert(batch, merge, *x) for x in [("s", 0), ("s", 0), ("s", 1), ("s", 0), ("t", 0), ("s", 1)]]
    assert done == [True, False, True, False, True, False]
    assert stored(table) == [("a", 3, 1, None)]
    assert table.version().applied == {"s": 1, "t": 0}


def test_only_touched_buckets_are_rewritten(spark, table):
    merge = rules()
    table.upsert(rows(spark, *[(f"k{i}", 1, 1, None) for i in range(40)]), merge)
    before = table.version().folders
    table.upsert(rows(spark, ("k7", 1, 1, None)), merge)
    after = table.version().folders
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().agg(F.sum("n")).first()[0] == 41


def test_a_lost_merge_leaves_the_table_as_it_was(spark, table, monkeypatch):
    merge = rules()
    table.upsert(rows(spark, ("a", 1, 1, None)), merge, "s", 0)

    def lost(self, version):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(M.MergeTable, "_commit", lost)
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, ("a", 1, 1, None), ("b", 1, 1, None)), merge, "s", 1)
    assert stored(table) == [("a", 1, 1, None)]
    table.upsert(rows(spark, ("a", 1, 1, None), ("b", 1, 1, None)), merge, "s", 1)
    assert stored(table) == [("a", 2, 1, None), ("b", 1, 1, None)]


def test_old_versions_go(spark, table, tmp_path):
    merge = rules()
    for i in range(6):
        table.upsert(rows(spark, ("a", 1, i, None), (f"k{i}", 1, i, None)), merge)
    assert sorted(p.name for p in (tmp_path / "t" / "manifest").glob("v=*")) == ["v=4", "v=5", "v=6"]
    assert table.read().agg(F.sum("n")).first()[0] == 12
    living = set(table.version().folders.values())
    files = {str(p.parent.relative_to(tmp_path / "t")) for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert living <= files and len([f for f in files if f not in living]) <= 4


def test_empty_batch_and_lookup(spark, table):
    merge = M.largest_row(["k"], ["k", "n", "seen", "note"], ["seen"])
    assert table.lookup(k="a").count() == 0
    table.upsert(rows(spark), merge, "s", 0)
    assert table.version().applied == {"s": 0} and stored(table) == []
    table.upsert(rows(spark, ("a", 1, 5, "x"), ("a", 2, 4, "y"), (None, 1, 1, "none")), merge)
    table.upsert(rows(spark, ("a", 3, 5, "newer")), merge)
    table.upsert(rows(spark, ("a", 4, 2, "older")), merge)
    assert list(map(tuple, table.lookup(k="a").collect())) == [("a", 3, 5, "newer")]
    assert list(map(tuple, table.lookup(k=None).collect())) == [(None, 1, 1, "none")]
    files = table.lookup(k="a").inputFiles()
    assert len({f.rsplit("/", 2)[-2] for f in files}) == 1 and len(files) < len(table.read().inputFiles()) + 1


def test_a_stream_that_loses_a_group_is_seen(spark, monkeypatch):
    """The closed flows are the stream's own: what it does not write is missing from the result."""
    from packetloom.plans.registry import QUERIES, oracle_sql
    from packetloom.streaming import flows as SF

    whole = SF.live_flow_stream
    monkeypatch.setattr(ST.SF, "live_flow_stream", lambda p, **o: whole(p, **o).where("capture_id <> 'cap1'"))
    folder = "/root/testdata/sf0.001"
    problem = difference(spark, duck(folder), QUERIES["live_flows_stream"], oracle_sql()["live_flows_stream"], folder)
    assert problem and "rows" in problem


def test_arrivals_hold_every_event_once(spark):
    folder = "/root/testdata/sf0.001"
    parts = [{r[0] for r in p.select("event_id").collect()} for p in ST.arriving(spark, folder)]
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert sum(map(len, parts)) == len(set().union(*parts)) == events.count() and all(parts)
    order = [r[0] for r in events.orderBy("ts").select("event_id").collect()]
    cut = len(parts[0])
    assert set(order[:cut]) != parts[0]  # out of order across steps


def test_scratch_tables_can_be_released(spark, monkeypatch):
    import os

    from packetloom import runtime

    monkeypatch.setitem(spark.__dict__, "_packetloom_scratch", [])
    made = runtime.materialize(spark.range(5), "released")
    folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder) and runtime.release(spark) == 1 and not os.path.exists(folder)
    assert runtime.release(spark) == 0
