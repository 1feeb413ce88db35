"""Numbers that a dashboard refreshes: totals, current states, top talkers, kept up to date batch by batch.

Nothing is counted anew: a micro-batch is reduced to few rows, and those are merged into stored tables
(``sources.merge_table``), so what is served after any batch equals the same query over everything that has come so far, and a
batch that is delivered twice counts once.

* totals are sums of what a batch adds;
* a view over *current* rows (the newest anomaly of every flow) gets both sides of a change: what it showed before is taken away, what
  it shows now is added;
* top talkers are a bounded summary per capture: at most ``capacity`` addresses with a lower bound of their weight and one number by
  which any weight may be too low. The summary names the candidates, their exact weights come from the stored packets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.runtime import delete_path, scratch_path
from packetloom.sources.merge_table import OLD, Merge, MergeTable, by_rules

TOTALS_DDL = "capture_id string, protocol string, packets bigint, bytes bigint, first_seen timestamp, last_seen timestamp"
TOTALS_KEY = ["capture_id", "protocol"]
TALKERS_DDL = "capture_id string, ip string, weight bigint, missed bigint"
CAPACITY = 1000


# ---- totals

def batch_totals(packets: DataFrame) -> DataFrame:
    return packets.groupBy(*TOTALS_KEY).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("bigint")).alias("bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def merge_totals() -> Merge:
    return by_rules(TOTALS_KEY, {"packets": F.sum("packets"), "bytes": F.sum("bytes"), "first_seen": F.min("first_seen"), "last_seen": F.max("last_seen")})


def totals_sink(table: MergeTable, stream: str) -> Callable[[DataFrame, int], None]:
    save = table.sink(merge_totals(), stream)
    return lambda batch, batch_id: save(batch_totals(batch), batch_id)


def served_totals(totals: DataFrame) -> DataFrame:
    """Packets, bytes and duration of everything so far, by label; the share is of the same capture."""
    whole = Window.partitionBy("capture_id")  # a row per label
    return totals.withColumn("share", F.col("packets") / F.sum("packets").over(whole))


# ---- counts of current rows

def view_sink(table: MergeTable, merge: Merge, view: MergeTable, measures: list[str], stream: str,
              show: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Merge batches into ``table`` and keep ``view``, the sums of ``show(row)`` over its rows, in step.

    ``show`` maps rows of the table to the view's keys and ``measures``. The view is merged first: a driver lost in between finds the
    table unchanged, computes the same change again, and the view's ledger knows it already.
    """
    add = by_rules(view.keys, {m: F.sum(m) for m in measures})

    def save(batch: DataFrame, batch_id: int) -> None:
        staged = scratch_path(table.spark, "view")
        batch.write.parquet(staged)
        new = table.spark.read.schema(batch.schema).parquet(staged)
        before, after = table.preview(new, merge)
        less = show(before).withColumns({m: -F.col(m) for m in measures})
        change = less.unionByName(show(after)).groupBy(*view.keys).agg(*[F.sum(m).alias(m) for m in measures])
        view.upsert(change, add, stream, batch_id)
        table.upsert(new, merge, stream, batch_id)
        delete_path(table.spark, staged)

    return save


# ---- top talkers

def batch_talkers(packets: DataFrame) -> DataFrame:
    """Bytes sent per address of a batch."""
    return packets.groupBy("capture_id", F.col("src_ip").alias("ip")).agg(
        F.sum(F.col("length").cast("bigint")).alias("weight")).where("ip IS NOT NULL").withColumn("missed", F.lit(0).cast("bigint"))


def merge_talkers(capacity: int = CAPACITY) -> Merge:
    """Add weights, then take the (capacity + 1)-th weight off all and drop what is not above zero.

    The sum of all that was taken off is ``missed``: true weights lie in [weight, weight + missed], and any address above
    ``missed`` is in the summary. A row without address carries the number even if no address is left.
    """
    def merge(rows: DataFrame) -> DataFrame:
        known = rows.where("ip IS NULL").groupBy("capture_id").agg(F.max("missed").alias("_known"))
        summed = rows.where("ip IS NOT NULL").groupBy("capture_id", "ip").agg(F.sum("weight").alias("weight"))
        heaviest = Window.partitionBy("capture_id").orderBy(F.col("weight").desc(), "ip")
        top = summed.withColumn("_rank", F.row_number().over(heaviest)).where(F.col("_rank") <= capacity + 1)
        cuts = top.groupBy("capture_id").agg(F.coalesce(F.max(F.when(F.col("_rank") == capacity + 1, F.col("weight"))), F.lit(0)).alias("_cut"))
        errors = cuts.join(known, "capture_id", "left").select("capture_id", "_cut", (F.col("_cut") + F.coalesce("_known", F.lit(0))).alias("missed"))
        kept = top.join(errors, "capture_id").where(F.col("weight") > F.col("_cut")).select(
            "capture_id", "ip", (F.col("weight") - F.col("_cut")).alias("weight"), "missed")
        return kept.unionByName(errors.select("capture_id", F.lit(None).cast("string").alias("ip"), F.lit(0).cast("bigint").alias("weight"), "missed"))

    return merge


def talkers_sink(table: MergeTable, stream: str, capacity: int = CAPACITY) -> Callable[[DataFrame, int], None]:
    """``table`` is keyed by capture alone, because a capture's summary is cut as a whole."""
    save = table.sink(merge_talkers(capacity), stream)
    return lambda batch, batch_id: save(batch_talkers(batch), batch_id)


def top_talkers(summary: DataFrame, packets: DataFrame, n: int) -> DataFrame:
    """The exact top ``n`` senders per capture: candidates from the summary, weights from the packets.

    Captures in which the n-th candidate does not outweigh what the summary may have missed are counted in full.
    """
    by_weight = Window.partitionBy("capture_id").orderBy(F.col("weight").desc(), "ip")
    listed = summary.where("ip IS NOT NULL").withColumn("_nth", F.nth_value("weight", n).over(
        by_weight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    candidates = listed.where(F.col("weight") + F.col("missed") >= F.coalesce("_nth", F.lit(0))).select("capture_id", "ip")
    missed = summary.where("ip IS NULL").select("capture_id", "missed")
    sent = packets.select("capture_id", F.col("src_ip").alias("ip"), F.col("length").cast("bigint").alias("bytes")).where("ip IS NOT NULL")

    def ranked(rows: DataFrame) -> DataFrame:
        weights = rows.groupBy("capture_id", "ip").agg(F.sum("bytes").alias("bytes"))
        place = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.col("bytes").desc(), "ip"))
        return weights.withColumn("rank", place).where(F.col("rank") <= n)

    checked = ranked(sent.join(candidates, ["capture_id", "ip"], "left_semi"))
    sure = checked.groupBy("capture_id").agg(F.min("bytes").alias("_least"), F.count(F.lit(1)).alias("_n"))
    proved = missed.join(sure, "capture_id", "left").withColumn(
        "proved", (F.col("missed") == 0) | (F.coalesce("_n", F.lit(0)) == n) & (F.coalesce("_least", F.lit(0)) > F.col("missed"))).select("capture_id", "proved")
    rest = ranked(sent.join(proved.where(~F.col("proved")), "capture_id", "left_semi"))
    return checked.join(proved.where("proved"), "capture_id", "left_semi").unionByName(rest)


def talker_bounds(summary: DataFrame, packets: DataFrame) -> DataFrame:
    """Per capture: do all listed weights enclose the truth, and is every address above the bound listed?"""
    truth = packets.where("src_ip IS NOT NULL").groupBy("capture_id", F.col("src_ip").alias("ip")).agg(F.sum(F.col("length").cast("bigint")).alias("bytes"))
    listed = summary.where("ip IS NOT NULL").select("capture_id", "ip", "weight")
    both = truth.join(listed, ["capture_id", "ip"], "left").join(summary.where("ip IS NULL").select("capture_id", "missed"), "capture_id")
    return both.groupBy("capture_id").agg(
        F.bool_and(F.col("weight").isNull() | F.col("bytes").between(F.col("weight"), F.col("weight") + F.col("missed"))).alias("enclosed"),
        F.bool_and(F.col("weight").isNotNull() | (F.col("bytes") <= F.col("missed"))).alias("complete"),
        F.count("weight").alias("listed"), F.max("missed").alias("missed"))
