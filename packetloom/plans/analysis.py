"""Capture files to tables, and questions to answers: the two end-to-end jobs.

Each step writes its table and the next one reads it, so nothing is recomputed and a lost executor
costs only its own tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.dissect import dissect
from packetloom.operators import chunks as C
from packetloom.operators import context as CX
from packetloom.operators import sparse as SP
from packetloom.operators.detect import Models, analyse
from packetloom.operators.explain import Complete, provider, suggested_questions
from packetloom.operators.facts import Facts, capture_summary, collect_facts, hosts, names, totals
from packetloom.operators.flows import capture_flows, inter_arrival
from packetloom.sources import capture_files as CF

QUESTION_KEYS = ["capture_id", "question_id"]


@dataclass
class Analysis:
    """Folder with the tables of one run."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.table(name)


def analyse_captures(spark: SparkSession, folder: str, out: str, models: Models | None = None) -> Analysis:
    """Tables packets, flows, sessions, chunks, postings and idf for every capture file in ``folder``."""
    run = Analysis(spark, out)
    frames = CF.scan_captures(spark, folder)
    packets = run.save("packets", inter_arrival(dissect(frames)))
    flows = run.save("flows", analyse(capture_flows(packets), models))
    facts = collect_facts(packets, flows)
    chunks = run.save("chunks", C.build_chunks(packets, flows, facts=facts))
    run.save("sessions", session_table(spark, folder, frames, packets, facts))
    postings, idf = SP.build_index(chunks, "chunk_id", "content", scope=["capture_id"])
    run.save("postings", postings)
    run.save("idf", idf)
    return run


def session_table(spark, folder, frames, packets, facts: Facts) -> DataFrame:
    """One row per file: totals, chunk count, or the reason why it could not be used."""
    status = CF.capture_status(spark, folder, frames, packets).select(
        "capture_id", F.element_at(F.split("capture_id", "/"), -1).alias("filename"),
        F.col("length").alias("file_size_bytes"), "error")
    counts = ["total_packets", "total_bytes", "total_flows", "total_anomalies", "dns_query_count", "chunk_count"]
    return (
        status.join(capture_summary(facts), "capture_id", "left")
        .fillna(0, counts).fillna(0.0, ["duration_seconds"]).withColumn("session_id", F.md5("capture_id"))
    )


def question_facts(facts: Facts) -> DataFrame:
    """Inputs of the question rules, one row per capture."""
    kinds = facts.of("type").groupBy("capture_id").agg(F.collect_list("item.name").alias("anomaly_types"))
    counts = {"dns_query_count": names(facts, 1).select("capture_id", F.col("packets_with_query").alias("dns_query_count")),
              "http_request_count": hosts(facts, 1).select("capture_id", F.col("request_count").alias("http_request_count"))}
    found = totals(facts).withColumn("protocols", F.transform("protocols", lambda p: p["protocol"])).join(kinds, "capture_id", "left")
    for part in counts.values():
        found = found.join(part, "capture_id", "left")
    return found.fillna(0, list(counts)).withColumn("anomaly_types", F.coalesce("anomaly_types", F.array().cast("array<string>")))


def question_table(facts: Facts) -> DataFrame:
    """Suggested questions, numbered from 1 per capture."""
    return suggested_questions(question_facts(facts)).select(
        "capture_id", F.posexplode("questions").alias("_pos", "question")).select(
        "capture_id", (F.col("_pos") + 1).cast("bigint").alias("question_id"), "question")


def find_sources(questions: DataFrame, chunks: DataFrame, postings: DataFrame, idf: DataFrame, k: int = SP.TOP_K,
                 dense: DataFrame | None = None) -> DataFrame:
    """Ranked chunks per question; vector hits (same columns) replace keyword hits where there are any."""
    vectors = SP.query_vectors(questions, idf, "question_id", "question", scope=["capture_id"])
    hits = SP.retrieve(postings, vectors, "chunk_id", "question_id", k, scope=["capture_id"])
    if dense is not None:
        hits = CX.choose_results(dense.select(*hits.columns), hits, QUESTION_KEYS)
    return CX.with_summary(hits, questions, chunks, "question_id").join(chunks, ["capture_id", "chunk_id"])


def ask(run: Analysis, questions: DataFrame, complete: Complete | None = None, k: int = SP.TOP_K) -> DataFrame:
    """``questions``: capture_id, question_id, question. Adds prompt, answer and sources."""
    ranked = find_sources(questions, run.table("chunks"), run.table("postings"), run.table("idf"), k)
    prompts = CX.build_prompts(questions, CX.pack_context(ranked, QUESTION_KEYS), run.table("sessions"), "question_id")
    answered = CX.answer(prompts, ranked, QUESTION_KEYS, complete or provider("mock"))
    return answered.join(CX.source_list(ranked, QUESTION_KEYS), QUESTION_KEYS, "left")
