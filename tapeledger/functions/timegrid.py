"""Columns on the fixed UTC time grid. Buckets are anchored at the epoch, never at a query's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

FREQUENCY_US = {"1h": HOUR_US, "4h": 4 * HOUR_US, "1d": DAY_US}


def epoch_us(col: Column | str) -> Column:
    """Microseconds since the epoch of a zoned or zone-less timestamp (session zone is UTC)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket_start(col: Column | str, width_us: int) -> Column:
    return from_epoch_us(epoch_us(col) - F.pmod(epoch_us(col), F.lit(width_us)))


def time_block(col: Column | str, width_us: int) -> Column:
    """Number of the ``width_us`` wide block a timestamp falls in; used to cut a long series into tasks."""
    return F.floor(epoch_us(col) / F.lit(width_us)).cast("bigint")


def moment(df: DataFrame, time: str, tie: str) -> Column:
    """Sort key of (time, tie) for first/last aggregates. With a whole-number tie both go into one DECIMAL(38,0):
    its buffer has a fixed size, so the aggregation stays a hash aggregation. Other ties need a struct, and Spark
    then sorts the rows before it combines them."""
    if not isinstance(df.schema[tie].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        return F.struct(time, tie)
    shifted = epoch_us(time).cast("decimal(18,0)") * F.expr("CAST('10000000000000000000' AS DECIMAL(20,0))")
    return (shifted.cast("decimal(38,0)") + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")
