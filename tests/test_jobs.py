import struct

from pyspark.sql import functions as F

from packetloom.operators.facts import collect_facts
from packetloom.plans import analysis as AN
from packetloom.sources.frame_fixture import frames_from_packets, write_captures
from packetloom.sources.tables import write_packets


def test_files_to_answers(spark, make_packets, tmp_path):
    rows = [{"us": i * 1000, "dst_port": 100 + i, "src_port": 5000, "tcp_flags": "SYN", "capture_id": "scan"} for i in range(12)]
    rows += [{"us": i * 1000, "protocol": "DNS", "dst_port": 53, "length": 120, "dns_query": f"d{i}.example.com", "capture_id": "names"}
             for i in range(3)]
    written = write_captures(frames_from_packets(make_packets(rows)), str(tmp_path / "in")).collect()
    assert sorted((r["file"], r["packets"]) for r in written) == [("names-0.pcap", 3), ("scan-0.pcap", 12)]
    (tmp_path / "in" / "empty.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
    run = AN.analyse_captures(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    sessions = {r["filename"]: r for r in run.table("sessions").collect()}
    assert sessions["scan-0.pcap"]["total_flows"] == 12 and sessions["scan-0.pcap"]["error"] is None
    assert sessions["names-0.pcap"]["dns_query_count"] == 3
    assert sessions["empty.pcap"]["error"] == "no parseable IP/ARP packets found" and sessions["empty.pcap"]["chunk_count"] == 0
    assert run.table("packets").where("inter_arrival_time is null").count() == 2
    scan = sessions["scan-0.pcap"]["capture_id"]
    assert run.table("chunks").where("category = 'port_scan'").select("capture_id").collect() == [(scan,)]
    asked = AN.question_table(collect_facts(run.table("packets"), run.table("flows")))
    asked = asked.unionByName(spark.createDataFrame([(scan, 99, "which source probed ports")], asked.schema))
    answers = {(r["capture_id"], r["question_id"]): r for r in AN.ask(run, asked).collect()}
    assert len(answers) == asked.count()
    mine = answers[(scan, 99)]
    categories = [s["category"] for s in mine["sources"]]
    assert "global_summary" in categories and "port_scan" in categories
    assert mine["prompt"].startswith("PCAP file: scan-0.pcap (12 packets, 12 flows, 0.0s duration)")
    assert mine["answer"] == f"(no model: {len(mine['prompt'])} characters of prompt were not read)"


def test_packet_table_is_laid_out_by_day(spark, make_packets, tmp_path):
    write_packets(make_packets([{"us": d * 86_400_000_000} for d in range(3)]), str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert read.where(F.col("day") == "2024-01-02").count() == 1 and len(list((tmp_path / "t").glob("day=*"))) == 3
