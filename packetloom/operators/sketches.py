"""Distinct counts that add up: one small sketch per capture, period and column, united over any range of periods.

A sketch (HyperLogLog) has ``2 ** log_k`` cells whatever it has seen, so the stored table grows with captures and periods, not with packets, and
a question over months reads a row per period instead of the packets. The estimate's relative error is below
``error_bound(log_k)`` in all but one of a thousand cases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 12
COLUMNS = {"dns_names": "dns_query", "http_hosts": "http_host", "sources": "src_ip", "flows": "flow_id"}


def error_bound(log_k: int = LOG_K, deviations: float = 3.3) -> float:
    """Relative error that is exceeded once in a thousand, from the sketch's standard error."""
    return deviations * 1.04 / math.sqrt(1 << log_k)


def period_sketches(packets: DataFrame, unit: str = "HOUR", columns: dict[str, str] = COLUMNS, log_k: int = LOG_K) -> DataFrame:
    """(capture_id, period, a sketch per column); combined before the shuffle, so a hot capture is a few rows."""
    return packets.groupBy("capture_id", F.date_trunc(unit, "timestamp").alias("period")).agg(
        *[F.hll_sketch_agg(c, log_k).alias(n) for n, c in columns.items()])


def distinct_between(sketches: DataFrame, start: Column, end: Column, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """Estimated distinct values per capture over the periods that begin in [start, end)."""
    chosen = sketches.where((F.col("period") >= start) & (F.col("period") < end))
    return chosen.groupBy("capture_id").agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in columns])


def exact_between(packets: DataFrame, start: Column, end: Column, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """The same, counted; one grouping set per column, so no packet is multiplied beyond that."""
    rows = packets.where((F.col("timestamp") >= start) & (F.col("timestamp") < end)).select("capture_id", *[F.col(c).alias(n) for n, c in columns.items()])
    names = list(columns)
    seen = rows.groupingSets([["capture_id", n] for n in names], "capture_id", *names).agg(F.count(F.lit(1)).alias("_n"))
    return seen.groupBy("capture_id").agg(*[F.count(n).alias(n) for n in names])


def within_bound(estimate: Column, exact: Column, log_k: int = LOG_K) -> Column:
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * error_bound(log_k))
