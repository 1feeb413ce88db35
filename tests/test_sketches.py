"""Sketches of periods against exact counts over their union."""

from pyspark.sql import functions as F

from packetloom.operators import sketches as SK
from packetloom.plans.catalog import at_second


def test_union_of_periods_counts_shared_values_once(spark, make_packets):
    rows = [{"capture_id": "ab"[i % 2], "us": (i % 240) * 1_000_000, "dns_query": f"d{i % 1700}.org" if i % 3 else None, "src_ip": f"10.0.{i % 7}.{i % 250}"}
            for i in range(12_000)]
    packets = make_packets(rows + [{"capture_id": "c", "us": 70_000_000}])
    sketches = SK.period_sketches(packets, "MINUTE")
    assert sketches.count() == 4 * 2 + 1
    for start, end in ((0, 240), (60, 180), (60, 120)):
        exact = {r["capture_id"]: r for r in SK.exact_between(packets, at_second(start), at_second(end)).collect()}
        for r in SK.distinct_between(sketches, at_second(start), at_second(end)).collect():
            for n in SK.COLUMNS:
                want = exact[r["capture_id"]][n]
                assert abs(r[n] - want) <= max(1, want * SK.error_bound())
        if "c" in exact:
            assert exact["c"]["dns_names"] == 0 and exact["c"]["sources"] == 1
    brute = packets.where("capture_id = 'a'").agg(F.countDistinct("dns_query"), F.countDistinct("flow_id")).first()
    whole = SK.exact_between(packets, at_second(0), at_second(240)).where("capture_id = 'a'").first()
    assert (whole["dns_names"], whole["flows"]) == tuple(brute)


def test_bound_shrinks_with_cells():
    assert SK.error_bound(14) < SK.error_bound(12) < 0.06
