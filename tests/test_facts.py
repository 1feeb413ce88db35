"""Facts add up, say what the tables say, and cost one pass."""

from pyspark.sql import functions as F

from packetloom.operators import chunks as C
from packetloom.operators import facts as FA
from packetloom.plans import catalog as K

FOLDER = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_one_pass_each(spark):
    packets = spark.read.parquet(f"{FOLDER}/events.parquet").transform(K.packets_from_events)
    assert scans(FA.packet_facts(packets)) == 1
    flows = K.materialize(K.scored(spark, FOLDER), "scored")
    assert scans(FA.flow_facts(flows)) == 1
    facts = FA.collect_facts(packets, flows)
    named = [f for df in (FA.capture_summary(facts), C.build_chunks(None, flows, facts=facts)) for f in df.inputFiles() if "events.parquet" in f]
    assert not named


def test_facts_of_parts_add_up(spark):
    packets = K.packets(spark, FOLDER)
    parts = [FA.packet_facts(packets.where(F.col("packet_id") % 3 == i)) for i in range(3)]
    united = FA.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(str, united.collect())) == sorted(map(str, FA.packet_facts(packets).collect()))


def test_chunk_number_is_that_of_the_chunks(spark, make_packets, make_flows):
    packets = make_packets([{"capture_id": c, "protocol": "UDP", "dns_query": q} for c, q in [("a", None), ("b", "x.org"), ("c", "")]]
                           + [{"capture_id": "d", "http_host": "h.org"}])
    flows = make_flows([{"capture_id": "a", "protocol": "UDP"}] + [{"capture_id": "b", "dst_port": i} for i in range(1, 13)]
                       + [{"capture_id": "d", "is_anomaly": True, "anomaly_type": None, "severity": None, "protocol": "UDP", "src_ip": None}])
    facts = FA.collect_facts(packets, flows)
    for ports in (2, 10, 20):
        want = {r["capture_id"]: r["chunks"] for r in C.chunk_counts(C.build_chunks(packets, flows, ports, facts)).groupBy("capture_id").agg(F.sum("chunks").alias("chunks")).collect()}
        got = {r["capture_id"]: r["chunk_count"] for r in FA.capture_summary(facts, ports).collect()}
        assert got == want and set(got) == set("abcd")


def test_names_hosts_and_nulls(make_packets, make_flows):
    packets = make_packets([{"src_ip": None, "length": 10}, {"src_ip": None, "length": 5}, {"dns_query": "b"}, {"dns_query": "a"}, {"dns_query": "b"}, {"http_host": "h"}])
    facts = FA.collect_facts(packets, make_flows([{}]))
    row = FA.names(facts, 1).first()
    assert (row["query_count"], row["packets_with_query"], row["queries"]) == (2, 3, ["b"])
    assert FA.hosts(facts, 5).first()["top_hosts"][0].asDict() == {"host": "h", "requests": 1}
    assert [(t["ip"], t["packets"], t["bytes"]) for t in FA.talkers(facts, 5).first()["talkers"]] == [("10.0.0.1", 4, 400), (None, 2, 15)]
    assert FA.totals(facts).first()["total_packets"] == 6
