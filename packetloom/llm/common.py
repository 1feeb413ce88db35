"""What the training-data operators share: words, tables, written intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.runtime import scratch_path

#: A word is a run of anything but ASCII white space; the same pattern serves Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; ``packetloom.runtime.release`` deletes what lies there."""
    return scratch_path(spark, f"llm-{label}")


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
