"""Live feeds, counters and sinks."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from packetloom.operators.anomalies import RuleThresholds
from packetloom.operators.detect import Models, analyse
from packetloom.operators.filters import live_event
from packetloom.streaming.flows import WATERMARK

ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def stream_table(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they land; the trigger limit is the back-pressure, nothing is dropped."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def packet_feed(packets: DataFrame) -> DataFrame:
    """One JSON event per packet: type and the 11 live fields."""
    fields = live_event(packets)
    data = F.struct(F.date_format("timestamp", ISO_TIME).alias("timestamp"), *[c for c in fields.columns if c != "timestamp"])
    return fields.select(F.to_json(F.struct(F.lit("packet").alias("type"), data.alias("data")),
                                   {"ignoreNullFields": "false"}).alias("value"))


def anomaly_feed(scored: DataFrame) -> DataFrame:
    """One JSON event per anomalous flow."""
    data = F.struct("flow_id", F.date_format("start_time", ISO_TIME).alias("start_time"), "if_score", "ae_score",
                    "ensemble_score", "is_anomaly", "anomaly_type", "severity")
    return scored.where("is_anomaly").select(
        F.to_json(F.struct(F.lit("anomaly").alias("type"), data.alias("data")), {"ignoreNullFields": "false"}).alias("value"))


def score_stream(closed_flows: DataFrame, models: Models | None, thresholds: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Score closed flows with the stored models; errors are divided by the training maximum."""
    return analyse(closed_flows, models, scope=(), thresholds=thresholds)


def protocol_minutes(packets: DataFrame, minutes: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Packets and bytes per label and minute."""
    return (
        packets.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", f"{minutes} minute").alias("w"), "protocol")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("bigint")).alias("bytes"))
        .select(F.col("w.start").alias("minute"), "protocol", "packets", "bytes")
    )


def session_activity(messages: DataFrame, ttl: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Sliding idle sessions per session id."""
    return (
        messages.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", ttl).alias("w"), "session_id")
        .agg(F.count(F.lit(1)).alias("message_count"))
        .select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"), "message_count")
    )


def idle_flows(packets: DataFrame, timeout: str = "120 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Timeout-only flows, entirely inside the JVM, for traffic where teardown does not matter."""
    return (
        packets.withWatermark("timestamp", watermark)
        .groupBy(F.session_window("timestamp", timeout).alias("w"), "capture_id", "flow_id")
        .agg(F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("length").cast("bigint")).alias("byte_count"),
             F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
        .select("capture_id", "flow_id", "start_time", "end_time", "packet_count", "byte_count")
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to ``path``, one folder per micro-batch; a repeated batch replaces its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_batches(stream, save, checkpoint, once)


def run_batches(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give every micro-batch to ``save``; ``once``: over what is there now, then stop."""
    watch(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_latest(stream: DataFrame, path: str, checkpoint: str, time_col: str, tie: str, n: int) -> StreamingQuery:
    """Maintain the newest ``n`` rows (500 packets, 100 anomalies) as a small table per micro-batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}"))
        top = rows.orderBy(F.col(time_col).desc(), F.col(tie).asc()).limit(n)
        top.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def end_mark(events: DataFrame, days: int = 365) -> DataFrame:
    """The last row once more, ``days`` later: it moves the watermark on, so that a stream closes what it still holds.

    Nothing follows the mark, so what it opens itself is never written.
    """
    last = events.where("ts IS NOT NULL").agg(F.max_by(F.struct(*events.columns), "ts").alias("_last")).where("_last IS NOT NULL").select("_last.*")
    return last.withColumn("ts", (F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).cast(events.schema["ts"].dataType))


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def observed(packets: DataFrame, name: str = "capture") -> DataFrame:
    """Count rows on their way through; read back with ``capture_counters``."""
    return packets.observe(name, F.count(F.lit(1)).alias("captured"))


class RunningCounts(StreamingQueryListener):
    """Sums over all progress records of a run, as they come; the query itself keeps only the newest."""

    def __init__(self):
        self.runs: dict[str, dict] = {}
        self.changed = threading.Condition()

    def onQueryStarted(self, event):
        with self.changed:
            self.runs[str(event.runId)] = {"captured": 0, "dropped": 0, "held": 0, "upto": None}

    def onQueryProgress(self, event):
        p = event.progress
        with self.changed:
            run = self.runs.get(str(p.runId))
            if run is not None:
                seen = p.observedMetrics.get("capture")
                run["captured"] += seen["captured"] if seen is not None else p.numInputRows
                run["dropped"] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
                run["held"] = sum(op.numRowsTotal for op in p.stateOperators)
                run["upto"] = (p.batchId, p.timestamp)
                self.changed.notify_all()

    def onQueryTerminated(self, event):
        pass


_watched: dict[str, RunningCounts] = {}


def watch(spark: SparkSession) -> RunningCounts:
    """Count the queries that start from now on; once per application and session."""
    key = f"{spark.sparkContext.applicationId}-{spark._jsparkSession.hashCode()}"
    if key not in _watched:
        listener = RunningCounts()
        spark.streams.addListener(listener)
        _watched[key] = listener
    return _watched[key]


def capture_counters(query: StreamingQuery, wait_s: float = 60) -> dict[str, int]:
    """Captured rows, rows dropped as late, rows held in state, over all micro-batches of the run.

    The query must have been started after ``watch`` (``write_batches`` sees to it).
    """
    listener = next((w for w in _watched.values() if str(query.runId) in w.runs), None)
    if listener is None:
        raise RuntimeError("the query was started before watch(spark): its older batches are not known")
    last = query.lastProgress
    with listener.changed:
        run = listener.runs[str(query.runId)]
        # Records come in order, but a little later than the query knows them.
        upto = None if last is None else (last.batchId, last.timestamp)
        if upto and not listener.changed.wait_for(lambda: run["upto"] is not None and run["upto"] >= upto, wait_s):
            raise TimeoutError(f"progress of batch {last.batchId} did not come in {wait_s} s")
        return {"total_captured": run["captured"], "total_dropped": run["dropped"], "queue_size": run["held"]}
