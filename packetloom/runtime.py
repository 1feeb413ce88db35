"""Physical-plan helpers: shared scratch space, size-checked broadcasts, salted joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or where it is unset the warehouse."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder; :func:`release` deletes what lies there."""
    path = f"{shared_dir(spark)}/packetloom-{label}-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("_packetloom_scratch", []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all scratch tables of this session; results that still read them have to be used or saved before."""
    paths = spark.__dict__.pop("_packetloom_scratch", [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def _located(spark: SparkSession, path: str):
    """(file system, path), wherever Spark's file systems reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens if there is none."""
    system, target = _located(spark, path)
    system.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> str:
    """Make a folder, for a stream that starts before its first file lands."""
    system, target = _located(spark, path)
    system.mkdirs(target)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back.

    Used where the same expensive result feeds several jobs; the files survive lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before costly per-row work; large scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after the row count has been checked; else leave the join to Spark."""
    return F.broadcast(df) if fits(df, max_rows) else df


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    size_col: str,
    spread_by: str,
    hot_rows: int = 1_000_000,
    how: str = "inner",
) -> DataFrame:
    """Join (inner or left) of ``big`` with its own per-key aggregate ``small`` without hot reducers.

    ``small[size_col]`` holds the number of ``big`` rows behind a key. Keys with more than
    ``hot_rows`` rows are cut into pieces of about that many by a hash of ``spread_by``; their
    aggregate row is repeated once per piece. The list of hot keys is broadcast only after its rows were counted.
    """
    sized = small.withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col(size_col) / F.lit(hot_rows)).cast("int")))
    hot = sized.where(F.col("_pieces") > 1).select(*keys, F.col("_pieces").alias("_hot_pieces"))
    salted_big = big.join(broadcast_if_small(hot), keys, "left").withColumn(
        "_salt",
        F.when(
            F.col("_hot_pieces").isNull(), F.lit(0)
        ).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_hot_pieces")).cast("int")),
    )
    salted_small = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    if how == "inner":
        # Sizes after an explode are guessed far too low; without the hint the whole aggregate may be broadcast.
        salted_small = salted_small.hint("merge")
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt", "_pieces", "_hot_pieces")
