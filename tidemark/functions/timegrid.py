"""Calendars, time buckets and zero filling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000

_STEP = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE"}


def millis(day: dt.date | dt.datetime) -> int:
    """Epoch milliseconds of a UTC date or naive UTC datetime."""
    moment = day if isinstance(day, dt.datetime) else dt.datetime(day.year, day.month, day.day)
    return int(moment.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def _bound(value: dt.date | dt.datetime, grain: str) -> Column:
    if grain in ("day", "month"):
        return F.trunc(F.lit(value).cast("date"), "month") if grain == "month" else F.lit(value).cast("date")
    width = HOUR if grain == "hour" else MINUTE
    return F.timestamp_millis(F.lit(millis(value) // width * width))


def calendar(spark: SparkSession, start, end, grain: str = "day", name: str = "bucket") -> DataFrame:
    """One row per day, month, hour or minute between two bounds, both kept."""
    if start > end:
        raise ValueError("calendar start is after its end")
    steps = F.sequence(_bound(start, grain), _bound(end, grain), F.expr(_STEP[grain]))
    return spark.range(1).select(F.explode(steps).alias(name))


def bucket_ms(ts_ms: Column | str, width_ms: int) -> Column:
    """Start of the fixed-width UTC bucket that holds an epoch-ms column."""
    col = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return (col - F.pmod(col, F.lit(width_ms))).cast("long")


def _wall_ms(ts_ms: Column | str, tz: str) -> Column:
    """Milliseconds on the wall clock of a zone. Only the epoch number counts, never the session's zone."""
    col = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return col if tz == "UTC" else F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(col), tz))


def day_of(ts_ms: Column | str, tz: str = "UTC") -> Column:
    """Calendar day of an epoch-ms column in a time zone, the same in a session of any zone."""
    return F.date_from_unix_date(F.floor(_wall_ms(ts_ms, tz) / DAY).cast("int"))


def hour_of(ts_ms: Column | str, tz: str = "UTC") -> Column:
    """Local hour start of an epoch-ms column: the moment at which a UTC clock shows that hour."""
    return F.timestamp_millis(bucket_ms(_wall_ms(ts_ms, tz), HOUR))


def utc_day(moment: Column | str) -> Column:
    """UTC day of a timestamp, the same in a session of any zone."""
    return day_of(F.unix_millis(moment))


def adaptive_width(start_ms: int, end_ms: int) -> int:
    """Chart bucket by range: up to 6 hours a minute, up to a day 5 minutes, else an hour."""
    span = end_ms - start_ms
    if span <= 6 * HOUR:
        return MINUTE
    return 5 * MINUTE if span <= DAY else HOUR


def in_days(col: Column | str, start: dt.date, end: dt.date) -> Column:
    """Both-ends-kept date range, the form that prunes date partitions."""
    col = F.col(col) if isinstance(col, str) else col
    return col.between(F.lit(start), F.lit(end))


def zero_fill(
    df: DataFrame,
    bucket: str,
    steps: Column,
    defaults: Mapping[str, object],
    by: Sequence[str] = (),
    groups: DataFrame | None = None,
) -> DataFrame:
    """Give every group every bucket of ``steps`` (an array column), with defaults where nothing happened.

    The grid is made by exploding the steps next to each distinct group, so no cross join is planned.
    """
    if by:
        base = (groups if groups is not None else df).select(*by).distinct()
    else:
        base = df.sparkSession.range(1).select()
    grid = base.select(*by, F.explode(steps).alias(bucket))
    joined = grid.join(df, [*by, bucket], "left")
    return joined.select(
        *by,
        bucket,
        *[
            (F.coalesce(F.col(c), F.lit(defaults[c])) if c in defaults else F.col(c)).alias(c)
            for c in df.columns
            if c != bucket and c not in by
        ],
    )


def ms_steps(start_ms: int, end_ms: int, width_ms: int) -> Column:
    """Bucket starts from ``start_ms`` up to, not including, ``end_ms``."""
    first = start_ms - start_ms % width_ms
    return F.sequence(F.lit(first).cast("long"), F.lit(end_ms - 1).cast("long"), F.lit(width_ms).cast("long"))


def day_steps(start: dt.date, end: dt.date) -> Column:
    return F.sequence(F.lit(start), F.lit(end), F.expr(_STEP["day"]))


def month_steps(start: dt.date, end: dt.date) -> Column:
    return F.sequence(F.lit(start.replace(day=1)), F.lit(end.replace(day=1)), F.expr(_STEP["month"]))
