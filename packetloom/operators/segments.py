"""Gap segmentation that stays parallel inside a hot key.

A plain window per key would sort all rows of the busiest key in one task. Keys are therefore counted first (combined before
the shuffle); those with more rows than a task should sort are cut into pieces at quantiles of their own times, so that pieces
hold about the same number of rows wherever the traffic is dense. A piece is scanned by itself and leaves partial segments
(first, last, open or closed, sums). Such partials merge associatively: inner ones are final, and of every piece at most two, at its
edges, can continue in the next, so a second scan over those few joins what belongs together. The outcome is that of one window per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.runtime import broadcast_if_small, materialize

ROWS_PER_TASK = 1_000_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def pieces(rows: DataFrame, keys: list[str], time_us: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """``rows`` with ``_piece``, ascending with time in every key; None if no key needs cutting.

    Rows of one microsecond stay together. Aimed at are pieces of half of ``rows_per_task``, since the quantiles are approximate.
    """
    if rows.count() <= rows_per_task:  # needs no column, so the files' own counts answer it
        return None
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    n = math.ceil(2 * largest / rows_per_task)
    hot = materialize(counts.select(*keys), "hot-keys")  # no more of them than all rows / rows_per_task
    shares = [i / n for i in range(1, n)]
    cuts = rows.alias("r").join(broadcast_if_small(hot).alias("h"), _same("r", "h", keys), "left_semi").groupBy(*keys).agg(
        F.percentile_approx(time_us, shares, max(10_000, 20 * n)).alias("_cuts"))
    cuts = materialize(cuts, "cuts")
    found = rows.alias("r").join(broadcast_if_small(cuts).alias("c"), _same("r", "c", keys), "left").select("r.*", "c._cuts")
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(time_us))), F.lit(0))
    return found.withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_cuts")


def gap_segments(
    rows: DataFrame,
    keys: list[str],
    time_us: str,
    tie: str,
    gap_us: int,
    partial: dict[str, Column],
    merge: dict[str, Column],
    closes: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per segment of consecutive rows of a key, ordered by (``time_us``, ``tie``).

    A row opens a new segment when it is the key's first, when the row before it ``closes`` the
    segment, or when it comes strictly more than ``gap_us`` after the row before it. ``partial``
    aggregates rows to segments of a piece, ``merge`` aggregates those (same names). The result
    also has ``first_us``, ``last_us`` and ``closed``.
    """
    cut = pieces(rows, keys, time_us, rows_per_task)
    place = [*keys] if cut is None else [*keys, "_piece"]
    flagged = (rows if cut is None else cut).withColumn("_closes", closes if closes is not None else F.lit(False))
    inside = Window.partitionBy(*place).orderBy(time_us, tie)
    opens = F.lag("_closes").over(inside) | (F.col(time_us) - F.lag(time_us).over(inside) > gap_us)
    local = (
        flagged.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int"))
        .withColumn("_local", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*place, "_local")
        .agg(
            F.min(time_us).alias("first_us"), F.max(time_us).alias("last_us"),
            F.max("_closes").alias("closed"), *[c.alias(n) for n, c in partial.items()],
        )
    )
    if cut is None:
        return local.drop("_local")
    piece = Window.partitionBy(*place)
    edge = (F.col("_local") == 0) | (F.col("_local") == F.max("_local").over(piece))
    # Inner segments get a lane of their own, so they never meet in the stitching window.
    laned = local.withColumn("_edge", edge).withColumn(
        "_lane", F.when(F.col("_edge"), F.lit(-1).cast("bigint"))
        .otherwise(F.xxhash64("_piece", "_local").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    )
    stitch = Window.partitionBy(*keys, "_lane").orderBy("_piece", "_local")
    joins = (
        (F.col("_local") == 0)
        & ~F.lag("closed").over(stitch)
        & (F.col("first_us") - F.lag("last_us").over(stitch) <= gap_us)
    )
    return (
        laned.withColumn("_joins", F.coalesce(joins, F.lit(False)))
        .withColumn("_seg", F.sum((~F.col("_joins")).cast("int")).over(
            stitch.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_lane", "_seg")
        .agg(
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
            F.max("closed").alias("closed"), *[c.alias(n) for n, c in merge.items()],
        )
        .drop("_lane", "_seg")
    )


def session_gaps(events: DataFrame, key: str, time_us: str, tie: str, ttl_seconds: int = 3600,
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Idle sessions: activity of a key ends when nothing follows within ``ttl_seconds``."""
    return gap_segments(
        events, [key], time_us, tie, ttl_seconds * 1_000_000,
        partial={"events": F.count(F.lit(1))}, merge={"events": F.sum("events")},
        rows_per_task=rows_per_task,
    ).drop("closed")
