"""Late rows kept beside the stream instead of dropped by it.

Stateful steps discard what lies behind their watermark and only count it. Here a micro-batch is split before them: rows behind the
watermark go to a side table with the batch they came in and their delay, all others to the table that the stateful steps
read. A batch's watermark is the latest time of all batches before it less the allowed delay, kept in one row per batch, so a
batch that is delivered again is split the same way and replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS_DDL = "latest_us bigint"


def _latest_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    if batch_id == 0:
        return None
    return spark.read.schema(MARKS_DDL).parquet(f"{path}/marks/batch={batch_id - 1}").first()["latest_us"]


def split_sink(path: str, time: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``accepted`` and ``late`` below ``path``, a folder per batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = _latest_before(spark, path, batch_id)
        mark = None if latest is None else latest - delay_seconds * 1_000_000
        us = F.unix_micros(time)
        behind: Column = F.lit(False) if mark is None else us <= mark
        batch.where(~behind).write.mode("overwrite").parquet(f"{path}/accepted/batch={batch_id}")
        batch.where(behind).withColumn("delay_us", F.lit(mark).cast("bigint") - us).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        newest = batch.agg(F.greatest(F.max(us), F.lit(latest).cast("bigint")).alias("latest_us"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return save


def accepted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows in time, with their batch."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/accepted")


def late(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows behind the watermark, with their batch and how far behind they were."""
    return spark.read.schema(f"{schema}, delay_us bigint, batch bigint").parquet(f"{path}/late")
