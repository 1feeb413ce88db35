"""Registered queries over tables that jobs write, update and serve: arriving packets, merged rows, stored layouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators import explain as E
from packetloom.operators import filters as P
from packetloom.operators import sketches as SK
from packetloom.plans.catalog import anomaly_table, at_second, capture_flows, packets, query, scored
from packetloom.runtime import make_folder, materialize, scratch_path
from packetloom.sources import layouts as L
from packetloom.sources.merge_table import MergeTable, by_rules, first_text, largest_row
from packetloom.sources.tables import EPOCH_2024_US, TIME_SQUEEZE, packets_from_events, read_table
from packetloom.streaming import dashboard as DB
from packetloom.streaming import feeds as FD
from packetloom.streaming import flows as SF
from packetloom.streaming import late as LT

#: Steps in which the events of a folder arrive, and how far they are out of order (below the watermark's 30 s).
STEPS = 5
DISORDER_SECONDS = 20
FLOW_KEY = ["capture_id", "flow_id", "start_time"]


def arriving(spark: SparkSession, folder: str, steps: int = STEPS, disorder_seconds: int = DISORDER_SECONDS) -> Iterator[DataFrame]:
    """The events in order of arrival, in ``steps`` parts of equal duration; an event arrives up to ``disorder_seconds`` late."""
    events = read_table(spark, folder, "events")
    us = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_2024_US) / TIME_SQUEEZE)
    delay = F.col("event_id") * 7_919_033 % (disorder_seconds * 1_000_000)
    timed = events.withColumn("_at", us + delay)
    low, high = timed.agg(F.min("_at"), F.max("_at")).first()
    step = F.floor((F.col("_at") - F.lit(low)) * steps / F.lit(high - low + 1))
    for i in range(steps):
        yield timed.where(step == i).drop("_at")


def landed_events(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The events that have landed below ``path``, as a stream."""
    schema = read_table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(make_folder(spark, f"{path}/in"))


def landed_packets(spark: SparkSession, folder: str, path: str) -> DataFrame:
    return packets_from_events(landed_events(spark, folder, path))


def land(part: DataFrame, path: str, step: int) -> None:
    part.write.parquet(f"{path}/in/step{step}")


def finish(start: Callable[[], StreamingQuery]) -> None:
    """Run to the end; a run that was interrupted on purpose is started again."""
    try:
        start().awaitTermination()
    except StreamingQueryException as e:
        if Interrupted.__name__ not in str(e):
            raise
        start().awaitTermination()


def in_steps(spark: SparkSession, folder: str, path: str, start: Callable[[int], StreamingQuery], **options) -> None:
    """Land the events step by step; after each step the stream runs over what is new and stops again."""
    for i, part in enumerate(arriving(spark, folder, **options)):
        land(part, path, i)
        finish(lambda: start(i))


class Interrupted(RuntimeError):
    """Stands for a driver that is lost after a merge and before the stream has noted its batch."""


def interrupted(save: Callable[[DataFrame, int], None], after: set[int]) -> Callable[[DataFrame, int], None]:
    """A sink that dies once after each of some batches, when its work is done."""
    left = set(after)

    def run(batch: DataFrame, batch_id: int) -> None:
        save(batch, batch_id)
        if batch_id in left:
            left.discard(batch_id)
            raise Interrupted(f"after batch {batch_id}")

    return run


# ---- live flows, in several disordered micro-batches

@query
def live_flows_stream(spark, folder):
    """All flows, written by the stream itself: the mark that ends the input closes the rest, which counts as open where nothing had ended it."""
    path = scratch_path(spark, "live-flows")
    stream = SF.live_flow_stream(landed_packets(spark, folder, path))
    run = lambda i: FD.write_batches(stream, f"{path}/rows/step{i}", f"{path}/checkpoint")
    in_steps(spark, folder, path, run)
    land(FD.end_mark(read_table(spark, folder, "events")), path, STEPS)
    finish(lambda: run(STEPS))
    written = FD.read_batches(spark, f"{path}/rows", stream.schema)
    return SF.as_of(written, packets(spark, folder).agg(F.max("timestamp").alias("_now")))


# ---- stored tables that streams and later jobs update

def stored_flows(spark, folder) -> MergeTable:
    """Closed flows merged into a table by a stream that is interrupted, delivered again and then run again over everything."""
    path = scratch_path(spark, "flow-table")
    stream = SF.live_flow_stream(landed_packets(spark, folder, path))
    table = MergeTable(spark, f"{path}/table", stream.schema, FLOW_KEY)
    merge = largest_row(FLOW_KEY, stream.columns, ["packet_count", "end_time"])
    save = interrupted(table.sink(merge, "live"), {1, 4})
    in_steps(spark, folder, path, lambda i: FD.run_batches(stream, save, f"{path}/checkpoint"))
    FD.run_batches(stream, table.sink(merge, "replay"), f"{path}/replay").awaitTermination()
    return table


@query
def flow_table_stream(spark, folder):
    return stored_flows(spark, folder).read()


def stored_sessions(spark, folder) -> MergeTable:
    """Sessions whose counts grow with every micro-batch; batches that come twice count once."""
    path = scratch_path(spark, "session-table")
    messages = landed_events(spark, folder, path).select(F.col("user_id").alias("session_id"), F.lit(1).cast("bigint").alias("message_count"),
                             F.col("ts").cast("timestamp").alias("last_active_at"))
    table = MergeTable(spark, f"{path}/table", messages.schema, ["session_id"])
    merge = by_rules(["session_id"], {"message_count": F.sum("message_count"), "last_active_at": F.max("last_active_at")})
    save = interrupted(table.sink(merge, "messages"), {0, 2})
    in_steps(spark, folder, path, lambda i: FD.run_batches(messages, save, f"{path}/checkpoint"))
    # The whole input under the same name once more: the table knows more batches than come now.
    FD.run_batches(messages, save, f"{path}/again").awaitTermination()
    return table


@query
def session_table_stream(spark, folder):
    return stored_sessions(spark, folder).read()


@query
def session_lookup(spark, folder):
    """One session by its id, from the bucket that holds it."""
    return stored_sessions(spark, folder).lookup(session_id=7)


@query
def explanations_stored(spark, folder):
    """Explanations written back to the stored anomalies, only where there is none."""
    anomalies = anomaly_table(spark, folder)
    table = MergeTable(spark, scratch_path(spark, "anomaly-table"), anomalies.schema, ["anomaly_id"])
    rest = [c for c in anomalies.columns if c not in ("anomaly_id", "explanation")]
    kept = F.min_by(F.struct(*rest), ~F.col("_old"))
    merge = lambda rows: rows.groupBy("anomaly_id").agg(kept.alias("_row"), first_text("explanation").alias("explanation")).select(
        "anomaly_id", "_row.*", "explanation")
    table.upsert(anomalies, merge)
    texts = E.explain_flows(scored(spark, folder)).select("capture_id", "flow_id", F.col("explanation").alias("_text"))
    for _ in range(2):  # the second run finds nothing left to write
        missing = table.read().where(F.coalesce("explanation", F.lit("")) == "")
        table.upsert(missing.join(texts, ["capture_id", "flow_id"]).withColumn("explanation", F.col("_text")), merge)
    return table.read().select("anomaly_id", "explanation")


# ---- stored layouts; minutes stand for days, since the packets of the driver tables lie within minutes

UNIT = "MINUTE"


def stored_table(spark, df: DataFrame, time: str) -> str:
    return L.store(df, scratch_path(spark, "layout"), time, UNIT)


@query
def stored_period_filter(spark, folder):
    name = stored_table(spark, packets(spark, folder), "timestamp")
    return L.in_period(spark, name, "timestamp", at_second(60), at_second(180), UNIT).select("packet_id", "timestamp", "protocol", "length")


@query
def stored_flow_lookup(spark, folder):
    name = stored_table(spark, packets(spark, folder), "timestamp")
    wanted = F.md5(F.lit("10.0.0.9:40008|192.168.0.1:8080|HTTP").cast("binary"))
    return L.flow(spark, name, wanted).select("capture_id", "packet_id", "timestamp", "src_ip", "dst_ip", "length", "flow_id")


@query
def stored_flow_report(spark, folder):
    flows = stored_table(spark, capture_flows(spark, folder), "start_time")
    return L.flow_report(spark, flows, stored_table(spark, anomaly_table(spark, folder), "detected_at"))


@query
def stored_latest_anomaly(spark, folder):
    name = stored_table(spark, anomaly_table(spark, folder), "detected_at")
    return L.latest_per_flow(spark, name).select("capture_id", "flow_id", "anomaly_id", "is_anomaly", "severity", "detected_at")


@query
def stored_busy_periods(spark, folder):
    """Traffic by protocol in the minutes in which a flow with a critical anomaly began."""
    name = stored_table(spark, packets(spark, folder), "timestamp")
    critical = anomaly_table(spark, folder).where("severity = 'critical'")
    chosen = L.in_periods_of(spark, name, critical, "start_time", UNIT)
    return chosen.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("bigint")).alias("bytes"))


# ---- numbers that refresh with every batch

def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def as_of(df: DataFrame, path: str, step: int) -> DataFrame:
    """What is served after a step, kept for comparison."""
    df.withColumn("step", F.lit(step).cast("bigint")).write.parquet(f"{path}/served/{step}")
    return df.sparkSession.read.parquet(f"{path}/served/{step}")


@query
def totals_live(spark, folder):
    """Totals by label as served after every batch."""
    path = scratch_path(spark, "totals")
    stream = landed_packets(spark, folder, path)
    table = MergeTable(spark, f"{path}/table", spark.createDataFrame([], DB.TOTALS_DDL).schema, DB.TOTALS_KEY, buckets=4)
    save = interrupted(DB.totals_sink(table, "packets"), {1})
    served = []
    for i, part in enumerate(arriving(spark, folder)):
        land(part, path, i)
        finish(lambda: FD.run_batches(stream, save, f"{path}/checkpoint"))
        served.append(as_of(DB.served_totals(table.read()), path, i))
    return union_all(served)


@query
def severities_live(spark, folder):
    """Flows by the severity of their newest anomaly, as served after every batch of anomalies."""
    path = scratch_path(spark, "severities")
    anomalies = anomaly_table(spark, folder).select("capture_id", "flow_id", "anomaly_id", "severity", "is_anomaly", "detected_at")
    stored = materialize(anomalies, "anomalies")
    low, high = stored.agg(F.unix_micros(F.min("detected_at")), F.unix_micros(F.max("detected_at"))).first()
    step = F.floor((F.unix_micros("detected_at") - low) * 3 / F.lit(high - low + 1))
    stream = spark.readStream.schema(stored.schema).option("recursiveFileLookup", "true").parquet(make_folder(spark, f"{path}/in"))
    current = MergeTable(spark, f"{path}/current", stored.schema, ["capture_id", "flow_id"], buckets=4)
    view = MergeTable(spark, f"{path}/view", spark.createDataFrame([], "severity string, flows bigint, flagged bigint").schema, ["severity"], buckets=2)
    show = lambda rows: rows.select("severity", F.lit(1).cast("bigint").alias("flows"), F.col("is_anomaly").cast("bigint").alias("flagged"))
    newest = largest_row(["capture_id", "flow_id"], stored.columns, ["detected_at", "anomaly_id"])
    save = interrupted(DB.view_sink(current, newest, view, ["flows", "flagged"], "anomalies", show), {0, 2})
    served = []
    for i in range(3):
        land(stored.where(step == i), path, i)
        finish(lambda: FD.run_batches(stream, save, f"{path}/checkpoint"))
        served.append(as_of(view.read().where("flows > 0"), path, i))
    return union_all(served)


def talker_summary(spark, folder, capacity: int) -> MergeTable:
    path = scratch_path(spark, "talkers")
    stream = landed_packets(spark, folder, path)
    table = MergeTable(spark, f"{path}/table", spark.createDataFrame([], DB.TALKERS_DDL).schema, ["capture_id"], buckets=4)
    save = interrupted(DB.talkers_sink(table, "packets", capacity), {3})
    in_steps(spark, folder, path, lambda i: FD.run_batches(stream, save, f"{path}/checkpoint"))
    return table


@query
def talkers_live(spark, folder):
    """The exact three largest senders per capture, from a summary of twelve addresses."""
    return DB.top_talkers(talker_summary(spark, folder, 12).read(), packets(spark, folder), 3)


@query
def talkers_live_bounds(spark, folder):
    """Whether the summary's weights enclose the truth and miss nobody above its bound."""
    bounds = DB.talker_bounds(talker_summary(spark, folder, 12).read(), packets(spark, folder))
    return bounds.select("capture_id", "enclosed", "complete", (F.col("listed") <= 12).alias("bounded"))


@query
def latest_n_stream(spark, folder):
    """The newest 500 packets, kept up to date batch by batch."""
    path = scratch_path(spark, "latest")
    stream = landed_packets(spark, folder, path)
    in_steps(spark, folder, path, lambda i: FD.keep_latest(stream, f"{path}/top", f"{path}/checkpoint", "timestamp", "packet_id", 500))
    return P.live_event(spark.read.schema(stream.schema).parquet(f"{path}/top/batch={STEPS - 1}"))


# ---- rows that come too late

LATE_DISORDER_SECONDS = 75


@query
def late_rows_stream(spark, folder):
    """Every packet with its batch, and how far behind the watermark it came if it did."""
    path = scratch_path(spark, "late")
    columns = "packet_id bigint, timestamp timestamp, protocol string"
    stream = landed_packets(spark, folder, path).select("packet_id", "timestamp", "protocol")
    save = interrupted(LT.split_sink(path, "timestamp", 30), {2})
    in_steps(spark, folder, path, lambda i: FD.run_batches(stream, save, f"{path}/checkpoint"), disorder_seconds=LATE_DISORDER_SECONDS)
    none = F.lit(None).cast("bigint").alias("delay_us")
    return LT.accepted(spark, path, columns).select("packet_id", "protocol", "batch", none).unionByName(
        LT.late(spark, path, columns).select("packet_id", "protocol", "batch", "delay_us"))


# ---- distinct counts from stored sketches

@query
def distinct_sketches(spark, folder):
    """Exact distinct counts of two minutes, and whether the estimates from stored sketches keep their bound."""
    p = packets(spark, folder)
    start, end = at_second(60), at_second(180)
    sketches = materialize(SK.period_sketches(p, UNIT), "sketches")
    estimates = SK.distinct_between(sketches, start, end).select("capture_id", *[F.col(n).alias(f"_{n}") for n in SK.COLUMNS])
    both = SK.exact_between(p, start, end).join(estimates, "capture_id")
    return both.select("capture_id", *SK.COLUMNS, *[SK.within_bound(F.col(f"_{n}"), F.col(n)).alias(f"{n}_within") for n in SK.COLUMNS])
