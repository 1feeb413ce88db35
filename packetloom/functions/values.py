"""Small numeric, time and output helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Engine-neutral output: timestamps as epoch microseconds, doubles rounded, counts as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounded from the exact binary value, ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def text(*parts) -> Column:
    """Concatenate literals and columns; Python strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
