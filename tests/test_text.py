import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import chunks as C
from packetloom.operators import context as CX
from packetloom.operators import dense as DN
from packetloom.operators import explain as E
from packetloom.operators import sparse as SP
from packetloom.runtime import salted_join


def test_families_of_a_scan(make_packets, make_flows):
    packets = make_packets([{"protocol": "DNS", "dns_query": q, "us": i} for i, q in enumerate(["b.com", "a.com", "b.com"])]
                           + [{"protocol": "HTTP", "http_host": "h.org", "http_method": "GET", "us": 2_000_000}])
    flows = make_flows([{"dst_port": i + 1, "tcp_rst_count": 1, "tcp_ack_count": 0} for i in range(12)]
                       + [{"is_anomaly": True, "anomaly_type": "port_scan", "severity": "high", "ensemble_score": 0.85,
                           "protocol": "UDP", "src_port": None, "packets_per_second": None, "bytes_per_second": None, "duration_seconds": 0.0}])
    rows = {(r["category"], i): r for i, r in enumerate(C.build_chunks(packets, flows).collect())}
    by = lambda c: [r for (k, _), r in rows.items() if k == c]
    assert {k for k, _ in rows} == {"global_summary", "talker", "dns", "http", "flow", "anomaly", "tcp_analysis", "port_scan"}
    summary = by("global_summary")[0]
    assert summary["content"] == (
        "Capture file: c. Total packets: 4. Total data transferred: 0.4 KB (0.00 MB). Capture duration: 2.00 seconds. "
        "Unique network flows: 13. Anomalies detected: 1. Protocol breakdown: DNS (3 packets, 75.0%), HTTP (1 packets, 25.0%).")
    assert json.loads(summary["metadata"]) == {"total_packets": 4, "total_flows": 13, "duration_seconds": 2.0, "anomaly_count": 1}
    assert by("dns")[0]["content"] == "DNS queries observed (2 unique domains): b.com, a.com."
    assert len(by("flow")) == 13
    odd = next(r for r in by("flow") if "ANOMALY" in r["content"])
    assert odd["content"] == (
        "Flow f012: UDP 192.168.1.1:* → 8.8.8.8:443. Packets: 100, bytes: 150000, duration: 0.000s, avg packet size: 1500B, "
        "rate: 0.0 pps / 0.0 KB/s. ANOMALY DETECTED — type: port_scan, severity: high, ensemble score: 0.850. ")
    assert "TCP flags — SYN:1 FIN:1 RST:1 ACK:0 PSH:50. " in by("flow")[0]["content"]
    scan = by("port_scan")[0]["content"]
    assert scan.startswith("Potential port scan activity detected from 1 source IP(s). 192.168.1.1 probed 12 distinct ports (e.g. [1, 2, 3")
    assert "12 flows with SYN but no ACK" in by("tcp_analysis")[0]["content"]
    assert by("anomaly")[0]["content"].endswith("Anomalous flow IDs: f012.")
    assert by("talker")[0]["content"] == "Top hosts by data volume: 10.0.0.1 sent 4 packets (0.4 KB)."


def test_absent_families(make_packets, make_flows):
    rows = C.build_chunks(make_packets([{"protocol": "UDP"}]), make_flows([{"protocol": "UDP"}])).collect()
    assert sorted(r["category"] for r in rows) == ["flow", "global_summary", "talker"]


def brute_tfidf(docs, query, stops):
    def terms(t):
        words = [w for w in __import__("re").findall(r"\w{2,}", t.lower()) if w not in stops]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counts = {d: terms(t) for d, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    q = unit(terms(query))
    scores = {d: round(sum(w * unit(c).get(t, 0) for t, w in q.items()), 6) for d, c in counts.items()}
    return sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:6]


DOCS = {1: "The port scan probed many ports. Port scan!", 2: "DNS query for example domains, many dns queries",
        3: "high volume transfer of data", 4: "a quiet capture", 5: "port 443 data transfer and the port scan", 6: "the of and"}


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_search_without_index_equals_the_index(spark, hot_rows):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")
    asked = {1: "port scan", 2: "data transfer dns domains", 3: "nothing known zzz", 4: "capture quiet port 443", 5: ""}
    queries = spark.createDataFrame(list(asked.items()), "q bigint, text string")
    stops = SP.english_stop_words()
    best, read = SP.search(docs, queries, "doc_id", "text", "q", "text", hot_rows=hot_rows)
    got = {}
    for r in best.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["score"], r["doc_id"]))
    assert got == {q: brute for q, t in asked.items() if (brute := brute_tfidf(DOCS, t, stops))}
    postings, idf = SP.build_index(docs, "doc_id", "text")
    reads = {r["q"]: r["postings_read"] for r in read.collect()}
    assert set(reads) == {1, 2, 4} and max(reads.values()) < postings.count()


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
@pytest.mark.parametrize("limit", [0, 500_000])
def test_sparse_retrieval_equals_brute_force(spark, monkeypatch, hot_rows, limit):
    monkeypatch.setattr(SP, "MAX_QUERY_TERMS", limit)
    queries = {1: "port scan", 2: "dns domains data", 3: "zebra", 4: "the"}
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(queries.items()), "q bigint, text string")
    postings, idf = SP.build_index(docs, "doc_id", "text", hot_rows=hot_rows)
    hits = SP.retrieve(postings, SP.query_vectors(asked, idf, "q", "text"), "doc_id", "q").collect()
    stops = set(SP.english_stop_words())
    for q, text in queries.items():
        got = [(r["score"], r["doc_id"]) for r in sorted(hits, key=lambda r: r["rank"]) if r["q"] == q]
        assert got == brute_tfidf(DOCS, text, stops)
    assert {r["q"] for r in hits} == {1, 2}


def test_scoped_index_keeps_captures_apart(spark):
    docs = spark.createDataFrame([("x", 1, "port scan"), ("y", 2, "port scan"), ("y", 3, "dns")], "capture_id string, doc_id bigint, text string")
    asked = spark.createDataFrame([("x", 1, "port"), ("y", 1, "port dns")], "capture_id string, q bigint, text string")
    postings, idf = SP.build_index(docs, "doc_id", "text", scope=["capture_id"])
    vectors = SP.query_vectors(asked, idf, "q", "text", scope=["capture_id"])
    hits = SP.retrieve(postings, vectors, "doc_id", "q", scope=["capture_id"]).collect()
    assert {(r["capture_id"], r["doc_id"]) for r in hits} == {("x", 1), ("y", 2), ("y", 3)}


def test_salted_join_is_a_join(spark):
    big = spark.range(1000).select(F.col("id"), (F.col("id") % 7 * (F.col("id") % 3)).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    plain = big.join(small, "k").select("id", "m").collect()
    salted = salted_join(big, small, ["k"], "n", "id", hot_rows=10).select("id", "m").collect()
    assert sorted(plain) == sorted(salted) and len(salted) == 1000


@pytest.mark.parametrize("broadcast_bytes", [0, 32_000_000])
def test_dense_retrieval_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(DN._blocks, "__defaults__", (24,))  # blocks of three vectors
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(200, 8)).astype(np.float32), rng.normal(size=(7, 8)).astype(np.float32)
    v[3] = 0
    table = lambda m, n: DN.normalise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{n} bigint, e array<float>"), "e")
    hits = DN.retrieve(table(v, "d").repartition(3), table(q, "q"), "d", "q", "e", k=5, broadcast_bytes=broadcast_bytes).collect()
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = unit(q.astype(float)) @ unit(v.astype(float)).T
    assert len(hits) == 35
    for i in range(7):
        want = np.argsort(-scores[i])[:5].tolist()
        assert [r["d"] for r in sorted(hits, key=lambda r: r["rank"]) if r["q"] == i] == want


def test_dense_retrieval_without_rows(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0])], "d bigint, e array<double>")
    for docs, queries in ((some.limit(0), some), (some, some.limit(0))):
        asked = queries.withColumnRenamed("d", "q")
        assert DN.retrieve(docs, asked, "d", "q", "e").count() == 0 and DN.retrieve_lsh(docs, asked, "d", "q", "e").count() == 0


def test_dense_plan_collects_nothing(spark):
    """Beside the size of the queries no job runs before the result is asked for."""
    docs = spark.range(4000).select(F.col("id").alias("d"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id"))).alias("e"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dense-plan", "")
    DN.retrieve(docs, docs.withColumnRenamed("d", "q"), "d", "q", "e", broadcast_bytes=0)
    jobs = tracker.getJobIdsForGroup("dense-plan")
    spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) <= 2


def test_buckets_find_the_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    v = np.concatenate([c + 0.5 * rng.normal(size=(60, 16)) for c in centres])
    v[5:300] = v[5]  # a vector that many rows have
    table = lambda m, n: DN.normalise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{n} bigint, e array<double>"), "e")
    docs, queries = table(v, "d"), table(v[::40] + 0.05, "q")
    exact = DN.retrieve(docs, queries, "d", "q", "e")
    found = DN.retrieve_lsh(docs, queries, "d", "q", "e")
    assert DN.recall(found, exact, "d", "q").agg(F.avg("recall")).first()[0] >= 0.9
    scores = {(r["q"], r["d"]): r["score"] for r in exact.collect()}
    got = {(r["q"], r["d"]): r["score"] for r in found.collect()}
    assert all(abs(got[p] - scores[p]) < 2e-6 for p in got if p in scores) and got
    few = DN.retrieve_lsh(docs, queries, "d", "q", "e", tables=1, bits=12, probes=1)
    assert DN.recall(few, exact, "d", "q").agg(F.avg("recall")).first()[0] < 0.9  # the measure notices


def test_copies_keep_what_can_be_found(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, float(i)]) for i in range(20)], "d bigint, e array<double>")
    kept = {r["d"] for r in DN.without_copies(rows, "d", "e", 3).collect()}
    assert kept == {1, 3, 5} | set(range(0, 20, 2))


def test_summary_is_always_there_once(spark):
    chunks = spark.createDataFrame([("c", "s", "global_summary"), ("c", "f", "flow")], "capture_id string, chunk_id string, category string")
    queries = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "capture_id string, q bigint")
    results = spark.createDataFrame([("c", 1, "f", 0.5, 1), ("c", 2, "f", 0.5, 1), ("c", 2, "s", 0.2, 2)],
                                    "capture_id string, q bigint, chunk_id string, score double, rank int")
    rows = CX.with_summary(results, queries, chunks, "q").orderBy("q", "rank").collect()
    assert [(r["q"], r["rank"], r["chunk_id"], r["score"]) for r in rows] == [
        (1, 1, "s", 1.0), (1, 2, "f", 0.5), (2, 1, "f", 0.5), (2, 2, "s", 0.2), (3, 1, "s", 1.0)]


def test_dense_hits_replace_sparse_ones(spark):
    ddl = "q bigint, chunk_id string, score double"
    dense, sparse = spark.createDataFrame([(1, "d", 0.9)], ddl), spark.createDataFrame([(1, "s", 0.5), (2, "s", 0.5)], ddl)
    assert sorted((r["q"], r["chunk_id"]) for r in CX.choose_results(dense, sparse, ["q"]).collect()) == [(1, "d"), (2, "s")]


def test_context_budget(spark):
    ranked = spark.createDataFrame([(1, i, "flow", "x" * 1000) for i in range(1, 11)], "q bigint, rank int, category string, content string")
    r = CX.pack_context(ranked, ["q"], 2500).first()
    assert r["sources_used"] == 3
    assert r["context"] == "\n\n".join(["[FLOW] " + "x" * 1000] * 2 + ["[FLOW] " + "x" * 500 + "…"])
    assert CX.pack_context(ranked, ["q"], 2000).first()["sources_used"] == 2


def test_answers_and_failures(spark):
    prompts = spark.createDataFrame([("c", 1, "good", "p1"), ("c", 2, "bad", "p2")], "capture_id string, q bigint, question string, prompt string")
    ranked = spark.createDataFrame([("c", 2, i, f"text {i}") for i in (1, 2, 3, 4)], "capture_id string, q bigint, rank int, content string")

    def model(texts):
        if "p2" in texts:
            raise RuntimeError("down")
        return [f" answer to {t} " for t in texts]

    rows = {r["q"]: r["answer"] for r in CX.answer(prompts, ranked, ["capture_id", "q"], model).collect()}
    assert rows[1] == "answer to p1"
    assert rows[2] == ("I was unable to generate an answer because the LLM provider returned an error: down. "
                       "Here is the most relevant context I found:\n\ntext 1\n\ntext 2\n\ntext 3")


def test_explanations(spark, make_flows):
    flows = make_flows([{}, {"is_anomaly": True, "anomaly_type": "rst_storm", "ensemble_score": 0.876, "duration_seconds": None}])
    rows = {r["flow_id"]: r["explanation"] for r in E.explain_flows(flows).collect()}
    assert rows["f000"] == "Normal TCP traffic from 192.168.1.1 to 8.8.8.8. 100 packets, 150000 bytes over 10.0s."
    assert rows["f001"] == "Anomalous TCP flow detected (type: rst_storm, score: 0.88). 100 packets, 150000 bytes from 192.168.1.1 to 8.8.8.8."
    assert {r["explanation"] for r in E.explain_flows(flows, E.provider("mock")).collect()} == set(
        E.mock_complete([r["prompt"] for r in E.flow_prompts(flows).collect()]))

    def broken(prompts):
        raise RuntimeError

    assert {r["flow_id"]: r["explanation"] for r in E.explain_flows(flows, broken).collect()} == rows
    with pytest.raises(ValueError):
        E.provider("nobody")
    assert E.healthy("mock") and not E.healthy("nobody")
    prompt = E.flow_prompts(flows).where("flow_id = 'f000'").first()["prompt"]
    head, body = prompt.split("\n\nAnomaly detection result:\n")
    assert json.loads(head.split(":\n", 1)[1])["tcp_flags"] == {"SYN": 1, "FIN": 1, "RST": 0, "ACK": 98, "PSH": 50}
    assert body.endswith("Explain this network flow in plain English.")


def test_only_empty_explanations_are_filled(spark):
    anomalies = spark.createDataFrame([("a", "old"), ("b", None), ("c", "")], "flow_id string, explanation string")
    new = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "new")], "flow_id string, explanation string")
    assert dict(E.fill_explanations(anomalies, new, ["flow_id"]).collect()) == {"a": "old", "b": "new", "c": "new"}


def test_questions(spark):
    df = spark.createDataFrame([("all", 3, 2, 1, ["TCP"], ["port_scan", "dns_spike", "data_exfiltration"]), ("none", 0, 0, 0, ["UDP"], [])],
                               "capture_id string, total_anomalies int, dns_query_count int, http_request_count int, protocols array<string>, anomaly_types array<string>")
    rows = {r["capture_id"]: r["questions"] for r in E.suggested_questions(df).collect()}
    assert len(rows["all"]) == 10 and "DNS spike" in rows["all"][8]
    assert len(rows["none"]) == 4 and rows["none"][-1].startswith("Were there any signs of retransmissions")


def test_asked_postings_weigh_as_in_the_whole_index(spark):
    """Only asked terms are posted, with the lengths of whole documents; an asked term of another scope is none of one's own."""
    docs = spark.createDataFrame([("a", i, f"flow number{i % 7} shared word{i} shared shared") for i in range(40)]
                                 + [("b", i, f"other flow{i % 3} shared") for i in range(5)], "capture_id string, doc long, body string")
    queries = spark.createDataFrame([("a", 1, "shared number3 unheard"), ("b", 1, "other number3"), ("b", 2, "shared")],
                                    "capture_id string, q long, words string")
    whole, _ = SP.build_index(docs, "doc", "body", scope=["capture_id"])
    asked = SP.asked_terms(queries, "q", "words", scope=["capture_id"])
    some, _ = SP.build_index(docs, "doc", "body", scope=["capture_id"], asked=asked, hot_rows=10)
    read = lambda df: {(r["capture_id"], r["doc"], r["term"]): round(r["weight"], 12) for r in df.collect()}
    wanted = {(r["capture_id"], r["term"]) for r in asked.collect()}
    expected = {k: w for k, w in read(whole).items() if (k[0], k[2]) in wanted}
    assert ("a", 3, "number3") in expected and read(some) == expected
