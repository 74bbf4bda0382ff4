"""Time functions on columns: integers of microseconds, never a session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, MINUTE, SECOND = 3_600_000_000, 60_000_000, 1_000_000
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def floor_div(a: Column, b: int) -> Column:
    """Integer division rounded down, also for negative numbers."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def duration_text(micros: Column) -> Column:
    """Hours, minutes and seconds above zero, as ``1 hours, 1 minutes , 1 seconds``; negative spans are split rounding down."""
    hours, rest = floor_div(micros, HOUR), F.pmod(micros, F.lit(HOUR))
    minutes, left = floor_div(rest, MINUTE), F.pmod(rest, F.lit(MINUTE))
    none = F.lit("")
    return F.when(micros.isNotNull(), F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" hours, "))).otherwise(none),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" minutes "), F.when(hours > 0, F.lit(", ")).otherwise(F.lit(" and ")))).otherwise(none),
        F.when(left > 0, F.concat(floor_div(left, SECOND).cast("string"), F.lit(" seconds"))).otherwise(none)))


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
