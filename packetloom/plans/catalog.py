"""Registered queries: each takes (spark, folder of the driver tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.dissect import dissect
from packetloom.functions.packet import flow_key, has_flag, protocol_label
from packetloom.functions.values import fixed, plain
from packetloom.operators import anomalies as A
from packetloom.operators import autoencoder as AE
from packetloom.operators import chunks as C
from packetloom.operators import context as CX
from packetloom.operators import dense as DN
from packetloom.operators import detect as D
from packetloom.operators import explain as E
from packetloom.operators import facts as FA
from packetloom.operators import filters as P
from packetloom.operators import flows as FL
from packetloom.operators import forest as FO
from packetloom.operators import reports as R
from packetloom.operators import segments as SG
from packetloom.operators import sparse as SP
from packetloom.operators import stats as S
from packetloom.plans import analysis as AN
from packetloom.plans import fixtures as X
from packetloom.runtime import make_folder, materialize, scratch_path
from packetloom.session import prepare
from packetloom.sources import capture_files as CF
from packetloom.sources.frame_fixture import frames_from_packets, write_captures
from packetloom.sources.tables import EPOCH_2024_US, packets_from_events, read_table
from packetloom.sources.tables import packets as build_packets
from packetloom.streaming import feeds as FD
from packetloom.streaming import flows as SF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Query:
    """Register under the function's name; output in engine-neutral types."""

    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(fn(prepare(spark), folder))

    QUERIES[fn.__name__] = run
    return run


def per_session(build):
    """Plans, not data: one lazy DataFrame per folder serves every use; it lives and dies with its session."""

    @wraps(build)
    def found(spark, folder):
        plans = spark.__dict__.setdefault("_packetloom_plans", {})
        if (build.__name__, folder) not in plans:
            plans[build.__name__, folder] = build(spark, folder)
        return plans[build.__name__, folder]

    return found


@per_session
def packets(spark, folder):
    return build_packets(spark, folder)


@per_session
def capture_flows(spark, folder):
    return FL.capture_flows(packets(spark, folder))


def live_flows(spark, folder):
    """All segments, with activity as of the last packet."""
    p = packets(spark, folder)
    now = p.agg(F.unix_micros(F.max("timestamp"))).scalar()
    return FL.close_at(FL.live_flows(p), now)


@per_session
def scored(spark, folder):
    return X.scored_flows(capture_flows(spark, folder))


@per_session
def anomaly_table(spark, folder):
    return X.anomaly_table(scored(spark, folder))


def at_second(n: int):
    return F.timestamp_micros(F.lit(EPOCH_2024_US + n * 1_000_000))


def map_text(c: str):
    """``key=value`` list of a map column, ordered by key."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


# ---- packets

@query
def all_packets(spark, folder):
    return packets(spark, folder)


QUERIES["packets"] = QUERIES.pop("all_packets")


@query
def dissect_frames(spark, folder):
    # Written first: real frames come from a scan, not from an expression to be repeated per field.
    return dissect(materialize(frames_from_packets(packets(spark, folder)), "frames"))


QUERIES["dissect"] = QUERIES.pop("dissect_frames")


@query
def flow_key_query(spark, folder):
    return packets(spark, folder).select("packet_id", flow_key().alias("flow_id"))


QUERIES["flow_key"] = QUERIES.pop("flow_key_query")


@query
def flag_membership(spark, folder):
    return packets(spark, folder).select(
        "packet_id", *[has_flag(f).alias(f.lower()) for f in FL.COUNTED_FLAGS])


@query
def protocol_label_query(spark, folder):
    p = packets(spark, folder)
    number = F.when(F.col("tcp_flags").isNotNull(), 6).when(F.col("src_port").isNotNull(), 17).otherwise(1)
    label = protocol_label(F.col("arp_op").isNotNull(), number, F.col("src_port"), F.col("dst_port"),
                           F.col("http_method").isNotNull(), F.col("dns_query").isNotNull())
    return p.select("packet_id", label.alias("protocol"))


QUERIES["protocol_label"] = QUERIES.pop("protocol_label_query")


@query
def packets_filter(spark, folder):
    return P.filter_packets(packets(spark, folder), protocol="tcp", dst_ip="192.168.0.2")


@query
def packets_page(spark, folder):
    return P.page(P.filter_packets(packets(spark, folder), protocol="https"), "packets", "timestamp",
                  ["packet_id"], limit=1000, offset=100)


@query
def packets_page_total(spark, folder):
    return P.filter_packets(packets(spark, folder), protocol="https").agg(F.count(F.lit(1)).alias("total"))


@query
def packet_lookup(spark, folder):
    return P.lookup(packets(spark, folder), "packet_id", 77)


@query
def capture_filter(spark, folder):
    spec = P.CaptureFilter(protocols=["tcp", "icmp"], src_ips=["192.168.0.1", "192.168.0.3", "10.0.0.8"])
    return P.capture_filter(packets(spark, folder), spec).select("packet_id", "protocol", "src_ip", "dst_port")


@query
def period_filter(spark, folder):
    return P.in_period(packets(spark, folder), "timestamp", at_second(60), at_second(180)).select(
        "packet_id", "timestamp", "protocol", "length")


@query
def live_text_filter(spark, folder):
    return P.live_text_filter(packets(spark, folder), "tcp").select("packet_id", "src_ip", "dst_ip", "protocol")


@query
def latest_n_packets(spark, folder):
    return P.live_event(P.latest(packets(spark, folder), "timestamp", ["packet_id"], 500))


@query
def packet_display(spark, folder):
    return P.packet_display(packets(spark, folder))


@query
def inter_arrival(spark, folder):
    return FL.inter_arrival(packets(spark, folder), slice_rows=50_000).select(
        "capture_id", "packet_id", "inter_arrival_time")


# ---- statistics

@query
def traffic_totals(spark, folder):
    return S.traffic_totals(packets(spark, folder), capture_flows(spark, folder), anomaly_table(spark, folder))


@query
def protocol_breakdown(spark, folder):
    return S.protocol_breakdown(packets(spark, folder))


@query
def top_talkers_packets(spark, folder):
    return S.top_talkers_by_packets(packets(spark, folder))


@query
def top_talkers_bytes(spark, folder):
    return S.top_talkers_by_bytes(packets(spark, folder))


@query
def talker_share(spark, folder):
    return S.talker_share(packets(spark, folder))


@query
def capture_duration(spark, folder):
    return S.capture_duration(packets(spark, folder))


@query
def protocol_counts(spark, folder):
    return S.protocol_counts(packets(spark, folder)).select("capture_id", map_text("protocol_counts").alias("protocol_counts"))


@query
def dns_distinct(spark, folder):
    return S.dns_names(packets(spark, folder))


@query
def dns_summary(spark, folder):
    return S.dns_summary(packets(spark, folder)).withColumn("queries", F.array_join("queries", ","))


@query
def http_requests(spark, folder):
    return S.http_requests(packets(spark, folder))


@query
def http_hosts(spark, folder):
    return S.top_per(S.http_hosts(packets(spark, folder)), ["capture_id"], [F.col("requests").desc(), F.col("host")], 20)


@query
def distinct_sizes(spark, folder):
    return S.distinct_sizes(packets(spark, folder))


@query
def anomaly_counts(spark, folder):
    return S.anomaly_counts(anomaly_table(spark, folder))


@query
def capture_summary(spark, folder):
    talker = lambda t: F.concat_ws("/", t["ip"], t["packets"].cast("string"), t["bytes"].cast("string"))
    # The flow facts are read once, so they need not be written.
    facts = FA.Facts(materialize(FA.packet_facts(packets(spark, folder)), "packet-facts"), FA.flow_facts(scored(spark, folder), ["scan"]))
    return (
        FA.capture_summary(facts, min_ports=2)
        .withColumn("protocol_counts", map_text("protocol_counts"))
        .withColumn("top_talkers", F.array_join(F.transform("top_talkers", talker), ","))
    )


# ---- flows

@query
def flows_capture(spark, folder):
    return capture_flows(spark, folder)


@query
def flows_live(spark, folder):
    return live_flows(spark, folder)


@query
def flows_filter(spark, folder):
    return P.filter_flows(live_flows(spark, folder), protocol="https", active_only=True)


@query
def flows_page(spark, folder):
    return P.page(P.filter_flows(live_flows(spark, folder), protocol="dns"), "flows", "start_time",
                  ["flow_id", "first_packet_id"], limit=500, offset=20)


@query
def flow_lookup(spark, folder):
    # The flow key is a filter on the packets already, so one flow is aggregated, not all of them.
    wanted = F.col("flow_id") == F.md5(F.lit("10.0.0.9:40008|192.168.0.1:8080|HTTP").cast("binary"))
    now = packets(spark, folder).agg(F.unix_micros(F.max("timestamp"))).scalar()
    return FL.close_at(FL.live_flows(packets(spark, folder).where(wanted)), now)


@query
def flow_display(spark, folder):
    return P.flow_display(capture_flows(spark, folder))


@query
def tcp_health(spark, folder):
    return FL.tcp_health(capture_flows(spark, folder))


@query
def port_scan(spark, folder):
    return FL.port_scanners(capture_flows(spark, folder), min_ports=2).select(
        "capture_id", "src_ip", "port_count", F.array_join("ports", ",").alias("ports"))


@query
def chunk_hosts(spark, folder):
    """Every host behind the HTTP chunk; its sentence names the first twenty."""
    return S.http_hosts(packets(spark, folder)).withColumn("category", F.lit("http"))


@query
def chunk_scanners(spark, folder):
    """Every scanner with every port behind the port-scan chunk."""
    return FL.port_scanners(capture_flows(spark, folder), min_ports=2).select(
        "capture_id", F.lit("port_scan").alias("category"), "src_ip", "port_count", F.explode("ports").alias("dst_port"))


@query
def port_scan_default(spark, folder):
    """Scanners by the default of ten ports."""
    return FL.port_scanners(capture_flows(spark, folder)).select("capture_id", "src_ip", "port_count")


@query
def session_table(spark, folder):
    """Sessions of the event users with their last activity; live are those within an hour of the last event."""
    events = read_table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    rollup = S.session_rollup(events)
    now = rollup.agg(F.max("last_active_at").alias("now"))
    live = S.live_sessions(rollup, now.scalar()).select(F.col("session_id"), F.lit(True).alias("live"))
    return rollup.join(live, "session_id", "left").select(
        "session_id", "message_count", "last_active_at", F.coalesce("live", F.lit(False)).alias("live"))


# ---- features and detectors

@query
def feature_vector(spark, folder):
    return A.feature_vector(capture_flows(spark, folder))


@query
def scaler_params(spark, folder):
    return plain(A.scaler_table(A.fit_scaler(A.feature_vector(capture_flows(spark, folder)))), 4)


@query
def scaled_features(spark, folder):
    features = A.feature_vector(capture_flows(spark, folder))
    scaled = plain(A.apply_scaler(features, A.fit_scaler(features)), 4)
    return scaled.select("capture_id", "flow_id", *[(F.col(f) + 0.0).alias(f) for f in A.FEATURES])


@query
def ensemble(spark, folder):
    return scored(spark, folder).select("capture_id", "flow_id", "if_score", "ae_score", "ensemble_score",
                                        "is_anomaly", "anomaly_type", "severity")


@query
def rule_anomalies(spark, folder):
    return scored(spark, folder).where("is_anomaly").groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("flows"))


@query
def severity_bands(spark, folder):
    return scored(spark, folder).groupBy("severity", "is_anomaly").agg(F.count(F.lit(1)).alias("flows"))


# ---- anomaly tables and reports

@query
def anomalies_filter(spark, folder):
    return P.filter_anomalies(anomaly_table(spark, folder), severity="high")


@query
def anomalies_page(spark, folder):
    return P.page(P.filter_anomalies(anomaly_table(spark, folder)), "anomalies", "detected_at", ["anomaly_id"],
                  limit=500, offset=10)


@query
def anomaly_lookup(spark, folder):
    key = F.concat(F.md5(F.lit("10.0.0.9:40008|192.168.0.1:8080|HTTP").cast("binary")), F.lit("-0"))
    return anomaly_table(spark, folder).where(F.col("anomaly_id") == key)


@query
def anomaly_display(spark, folder):
    return P.anomaly_display(anomaly_table(spark, folder))


@query
def latest_anomaly(spark, folder):
    return A.flows_with_latest(capture_flows(spark, folder), anomaly_table(spark, folder)).select(
        "capture_id", "flow_id", "protocol", "packet_count", "is_anomaly", "anomaly_type", "ensemble_score",
        "severity", "detected_at")


@query
def flow_anomaly_report(spark, folder):
    return A.flow_anomaly_report(capture_flows(spark, folder), anomaly_table(spark, folder))


@query
def live_union_dedupe(spark, folder):
    flagged = anomaly_table(spark, folder).where("is_anomaly")
    order = [F.col("detected_at").desc(), F.col("anomaly_id")]
    keep = ["anomaly_id", "flow_id", "severity", "position"]
    live = S.top_per(flagged.where(F.col("anomaly_id").endswith("-0")), [], order, 100, "position").select(*keep)
    stored = S.top_per(flagged, [], order, 500, "position").select(*keep)
    return A.merge_live(live, stored).select("anomaly_id", "flow_id", "severity", "origin")


# ---- sessions and messages

@query
def session_gaps(spark, folder):
    events = read_table(spark, folder, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return SG.session_gaps(events, "user_id", "us", "event_id")


@query
def session_rollup(spark, folder):
    messages = read_table(spark, folder, "conversations").withColumnRenamed("conv_id", "session_id")
    return S.session_rollup(messages, "session_id", "turn")


@query
def chat_history(spark, folder):
    messages = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    return E.chat_history(messages)


# ---- reports

@query
def report_summary(spark, folder):
    p, f, a = R.restrict(packets(spark, folder), capture_flows(spark, folder), anomaly_table(spark, folder), at_second(60))
    return R.report_summary(p, f, a)


@query
def top_anomalies(spark, folder):
    return R.top_anomalies(anomaly_table(spark, folder))


@query
def json_report_parts(spark, folder):
    return R.json_parts(packets(spark, folder), capture_flows(spark, folder), anomaly_table(spark, folder))


# ---- text chunks and retrieval

def chunk_table(spark, folder, persist=True):
    """Facts and chunks of all captures; the scored flows are written, since they are read for both."""
    s = materialize(scored(spark, folder), "scored")
    facts = FA.collect_facts(packets(spark, folder), s)
    chunks = C.build_chunks(None, s, min_ports=2, facts=facts)
    return facts, materialize(chunks, "chunks") if persist else chunks


@query
def chunks_text(spark, folder):
    return chunk_table(spark, folder, persist=False)[1]


@query
def chunk_counts(spark, folder):
    return C.chunk_counts(chunk_table(spark, folder, persist=False)[1])


@query
def suggested_questions(spark, folder):
    facts = FA.collect_facts(packets(spark, folder), scored(spark, folder), ["type"])
    return AN.question_table(facts).withColumnRenamed("question_id", "question_no")


@query
def tfidf_terms(spark, folder):
    postings, _ = SP.build_index(read_table(spark, folder, "documents"), "doc_id", "text", keep_tf=True)
    return plain(postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.sum("weight").alias("weight_sum"),
        F.max("weight").alias("top_weight")), 4)


def keyword_search(spark, folder):
    return SP.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), "doc_id", "text", "item_id", "text")


def keyword_hits(spark, folder):
    return keyword_search(spark, folder)[0]


@query
def tfidf_postings_read(spark, folder):
    """How many postings each query meets."""
    return keyword_search(spark, folder)[1]


@query
def tfidf_topk(spark, folder):
    return keyword_hits(spark, folder)


def retrieval(spark, folder):
    """Suggested questions answered from their capture's chunks, summary chunk always included."""
    facts, chunks = chunk_table(spark, folder)
    questions = AN.question_table(facts)
    asked = SP.asked_terms(questions, "question_id", "question", scope=["capture_id"])
    postings, idf = SP.build_index(chunks, "chunk_id", "content", scope=["capture_id"], asked=asked)
    return facts, questions, AN.find_sources(questions, chunks, postings, idf)


ANSWER_KEYS = AN.QUESTION_KEYS


@query
def chat_retrieval(spark, folder):
    return retrieval(spark, folder)[2].select(*ANSWER_KEYS, "chunk_id", "score", "rank", "category")


@query
def context_budget(spark, folder):
    # A small budget, so that the cut is reached on the driver tables.
    return CX.pack_context(retrieval(spark, folder)[2], ANSWER_KEYS, max_chars=700)


@query
def source_list(spark, folder):
    line = lambda x: F.concat_ws("|", x["category"], x["content"], fixed(x["score"], 4), x["metadata"])
    listed = CX.source_list(retrieval(spark, folder)[2], ANSWER_KEYS, shown=4)
    return listed.withColumn("sources", F.array_join(F.transform("sources", line), "\n"))


@query
def answers_batch(spark, folder):
    facts, questions, ranked = retrieval(spark, folder)
    captures = FA.capture_summary(facts).withColumn("filename", F.col("capture_id"))
    prompts = CX.build_prompts(questions, CX.pack_context(ranked, ANSWER_KEYS), captures, "question_id")
    return CX.answer(prompts, ranked, ANSWER_KEYS, E.provider("mock"))


@query
def answer_failures(spark, folder):
    """Answers while the model cannot be reached: an apology and the three best texts."""
    def unreachable(prompts):
        raise ConnectionError("model not reachable")

    facts, questions, ranked = retrieval(spark, folder)
    captures = FA.capture_summary(facts).withColumn("filename", F.col("capture_id"))
    prompts = CX.build_prompts(questions, CX.pack_context(ranked, ANSWER_KEYS), captures, "question_id")
    return CX.answer(prompts, ranked, ANSWER_KEYS, unreachable).select(*ANSWER_KEYS, "answer")


@query
def retrieval_choice(spark, folder):
    """Vector hits for the items that have some (those numbered like a label), keyword hits for the others."""
    dense = dense_hits(spark, folder).select(F.col("label").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    sparse = keyword_hits(spark, folder).select("item_id", "doc_id", "score", "rank")
    return CX.choose_results(dense, sparse, ["item_id"])


@query
def dense_normalise(spark, folder):
    u = DN.normalise(read_table(spark, folder, "embeddings"), "embedding")
    return u.select("vec_id", F.size("embedding").alias("dims"),
                    F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("length_sq"),
                    F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"))


def dense_tables(spark, folder):
    """Unit vectors, and the centre of every label as query."""
    unit = DN.normalise(read_table(spark, folder, "embeddings"), "embedding")
    parts = unit.select(F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
    centres = means.groupBy("label").agg(F.transform(ordered, lambda e: e["m"]).alias("embedding"))
    return unit, DN.normalise(centres, "embedding")


def dense_hits(spark, folder):
    return DN.retrieve(*dense_tables(spark, folder), "vec_id", "label", "embedding")


@query
def dense_topk(spark, folder):
    """Nearest vectors to the centre of every label."""
    return dense_hits(spark, folder)


@query
def dense_lsh(spark, folder):
    """What the bucket index finds of the exact hits: recall over all labels, and whether its scores are the exact ones."""
    unit, centres = dense_tables(spark, folder)
    centres = materialize(centres, "centres")
    found = materialize(DN.retrieve_lsh(unit, centres, "vec_id", "label", "embedding"), "lsh-hits")
    exact = materialize(DN.retrieve(unit, centres, "vec_id", "label", "embedding"), "dense-hits")
    overall = DN.recall(found, exact, "vec_id", "label").agg((F.avg("recall") >= 0.9).alias("recall_reached"))
    same = found.join(exact.select("label", "vec_id", F.col("score").alias("_exact")), ["label", "vec_id"], "left")
    per_label = same.groupBy("label").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"),
                                          F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("_exact")) < 2e-6, F.lit(True))).alias("scores_exact"))
    return per_label.withColumn("recall_reached", F.lit(overall.first()[0]))


# ---- explanations

@query
def explanation_template(spark, folder):
    return E.explain_flows(scored(spark, folder)).select("capture_id", "flow_id", "explanation")


@query
def explanations_fill(spark, folder):
    explained = E.explain_flows(scored(spark, folder))
    return E.fill_explanations(anomaly_table(spark, folder), explained, ["capture_id", "flow_id"]).select(
        "anomaly_id", "explanation")


@query
def flow_prompts(spark, folder):
    return E.flow_prompts(scored(spark, folder)).select("capture_id", "flow_id", "prompt")


# ---- detectors

@query
def iforest_scores(spark, folder):
    features = A.feature_vector(materialize(capture_flows(spark, folder), "flows"))
    scaled = A.apply_scaler(features, A.fit_scaler(features))
    forest = FO.fit_forest(scaled, ["capture_id", "flow_id"])
    return FO.score_forest(scaled, forest).select("capture_id", "flow_id", "raw_score", "score", "is_anomaly")


@query
def autoencoder_scores(spark, folder):
    features = A.feature_vector(materialize(capture_flows(spark, folder), "flows"))
    scaled = A.apply_scaler(features, A.fit_scaler(features))
    model = AE.fit_autoencoder(scaled, ids=["capture_id", "flow_id"])
    return AE.score_autoencoder(scaled, model, ["capture_id"]).select(
        "capture_id", "flow_id", "reconstruction_error", "score", "is_anomaly")


@query
def detector_pipeline(spark, folder):
    """Train on all flows, store the models, load them again and score."""
    flows = materialize(capture_flows(spark, folder), "flows")
    models = D.train(flows)
    path = scratch_path(spark, "models")
    D.save_models(spark, models, path)
    return D.analyse(flows, D.load_models(spark, path)).select(
        "capture_id", "flow_id", "if_score", "ae_score", "ensemble_score", "is_anomaly", "anomaly_type", "severity")


@query
def detector_contract(spark, folder):
    """A detector of one's own: fitted, then scoring, by the contract that the two models follow as well."""
    features = A.feature_vector(capture_flows(spark, folder))
    scaled = A.apply_scaler(features, A.fit_scaler(features))
    keys = ["capture_id", "flow_id"]
    return plain(D.DeviationDetector().fit(scaled, keys).score_flows(scaled).select(*keys, "score", "is_anomaly"), 4)


# ---- capture files

@query
def pcap_scan(spark, folder):
    """Write the packets as capture files, scan the files, dissect the frames."""
    path = scratch_path(spark, "captures")
    write_captures(frames_from_packets(packets(spark, folder)), path).collect()
    scanned = dissect(CF.scan_captures(spark, path))
    return scanned.withColumn("capture_id", F.regexp_extract("capture_id", r"([^/]+)\.pcap$", 1))


@query
def capture_files(spark, folder):
    """Status of every landed file: admitted, readable, with packets."""
    path = scratch_path(spark, "captures")
    write_captures(frames_from_packets(packets(spark, folder)), path).collect()
    frames = CF.scan_captures(spark, path)
    status = CF.capture_status(spark, path, frames, dissect(frames))
    return status.withColumn("capture_id", F.regexp_extract("capture_id", r"([^/]+)\.pcap$", 1))


# ---- streams

def packet_stream(spark, folder):
    schema = read_table(spark, folder, "events").schema
    return packets_from_events(FD.stream_table(spark, folder, schema, "events.parquet"))


def run_to_table(spark, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything that is there and return what it wrote."""
    path = scratch_path(spark, label)
    FD.write_batches(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return FD.read_batches(spark, f"{path}/rows", stream.schema)


def run_to_end(spark, folder, build, label: str) -> DataFrame:
    """Run ``build(events)`` over all events, end the input by its mark and run on: the stream itself closes what was open."""
    path = scratch_path(spark, label)
    events = read_table(spark, folder, "events")
    marks = FD.stream_table(spark, make_folder(spark, f"{path}/end"), events.schema)
    stream = build(FD.stream_table(spark, folder, events.schema, "events.parquet").unionByName(marks))
    FD.write_batches(stream, f"{path}/rows/all", f"{path}/checkpoint").awaitTermination()
    FD.end_mark(events).write.mode("append").parquet(f"{path}/end")
    FD.write_batches(stream, f"{path}/rows/end", f"{path}/checkpoint").awaitTermination()
    return FD.read_batches(spark, f"{path}/rows", stream.schema)


@query
def protocol_minutes_stream(spark, folder):
    return run_to_end(spark, folder, lambda events: FD.protocol_minutes(packets_from_events(events)), "minutes")


@query
def packet_feed_stream(spark, folder):
    return run_to_table(spark, FD.packet_feed(packet_stream(spark, folder)), "feed")


@query
def capture_counters_stream(spark, folder):
    """Counters of a feed that reads the packets in several micro-batches."""
    path = scratch_path(spark, "counted")
    events = read_table(spark, folder, "events")
    events.repartition(8).write.parquet(f"{path}/in")
    feed = FD.packet_feed(FD.observed(packets_from_events(FD.stream_table(spark, f"{path}/in", events.schema, files_per_trigger=1))))
    run = FD.write_batches(feed, f"{path}/rows", f"{path}/checkpoint")
    run.awaitTermination()
    counters = FD.capture_counters(run)
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{c} long" for c in counters))


@query
def anomaly_feed_stream(spark, folder):
    """Closed flows of the stream, scored with models trained on the finished captures."""
    flows = materialize(capture_flows(spark, folder), "flows")
    models = D.train(flows)
    closed = SF.live_flow_stream(packet_stream(spark, folder))
    return run_to_table(spark, FD.anomaly_feed(FD.score_stream(closed, models)), "alerts")


@query
def session_windows_stream(spark, folder):
    messages = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"))
    return run_to_end(spark, folder, lambda events: FD.session_activity(messages(events)), "sessions")


@query
def idle_flows_stream(spark, folder):
    return run_to_end(spark, folder, lambda events: FD.idle_flows(packets_from_events(events)), "idle-flows")


@query
def fuse_detectors(spark, folder):
    """Detector outputs as separate tables, joined to the flows; either may lack a flow."""
    flows = capture_flows(spark, folder)
    given = X.detector_scores(flows)
    keys = ["capture_id", "flow_id"]
    tables = [given.where(F.col(f"{d}_score").isNotNull()).select(
        *keys, F.col(f"{d}_score").alias("score"), F.col(f"{d}_flag").alias("is_anomaly")) for d in ("if", "ae")]
    return A.fuse_detectors(flows, tables, keys, X.RULES).select(
        *keys, "ensemble_score", "is_anomaly", "anomaly_type", "severity")


# ---- written reports, read back

def written_report(spark, folder, fmt: str):
    path = scratch_path(spark, "reports")
    row = R.generate_report(spark, "traffic", fmt, path, packets(spark, folder), capture_flows(spark, folder),
                            anomaly_table(spark, folder))
    return path, row


@query
def csv_report(spark, folder):
    _, row = written_report(spark, folder, "csv")
    schema = A.flow_anomaly_report(capture_flows(spark, folder), anomaly_table(spark, folder)).schema
    read = spark.read.schema(schema).option("header", True).option("timestampFormat", R.ISO_TIME).csv(row.first()["file_path"])
    # CSV knows no difference between an empty text and none; the report's blanks are texts.
    return read.fillna("", ["anomaly_type", "severity", "explanation"])


@query
def json_report_anomalies(spark, folder):
    _, row = written_report(spark, folder, "json")
    ddl = "flow_id string, type string, severity string, score double, explanation string, detected_at string"
    return spark.read.schema(ddl).json(f"{row.first()['file_path']}/anomalies")


@query
def report_registry(spark, folder):
    path, _ = written_report(spark, folder, "pdf")
    return R.list_reports(spark, path).select("name", "format", "packet_count", "flow_count", "anomaly_count")


@query
def json_report_document(spark, folder):
    """The written JSON document, taken apart again."""
    _, row = written_report(spark, folder, "json")
    return R.read_document(spark, row.first()["file_path"])


@query
def report_lookup(spark, folder):
    """One report found by its name in a registry of two."""
    path, _ = written_report(spark, folder, "pdf")
    R.generate_report(spark, "other", "csv", path, packets(spark, folder), capture_flows(spark, folder), anomaly_table(spark, folder))
    return R.find_report(spark, path, "other").select("name", "format", "packet_count", "flow_count", "anomaly_count")
