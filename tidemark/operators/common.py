"""Filters and measures that many operators share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ["package_nm", "server_type", "os_type"]


def app(
    df: DataFrame, package: str | None = None, server: int | None = None, os_type: str | None = None
) -> DataFrame:
    """Rows of one app; any part may be left open."""
    for name, value in (("package_nm", package), ("server_type", server), ("os_type", os_type)):
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def between_ms(df: DataFrame, col: str, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """Half-open epoch-ms range, with the day range beside it where the table is split by day.

    ``log_date`` is the day a row starts; for an end time it bounds the range from above only.
    """
    starts = col in ("log_tm", "page_start_tm")
    for ms, low in ((start_ms, True), (end_ms, False)):
        if ms is None:
            continue
        df = df.filter(F.col(col) >= ms if low else F.col(col) < ms)
        if "log_date" in df.columns and (starts or not low):
            day = dt.datetime.fromtimestamp((ms if low else ms - 1) / 1000, dt.timezone.utc).date()
            df = df.filter(F.col("log_date") >= F.lit(day) if low else F.col("log_date") <= F.lit(day))
    return df


def on_day(df: DataFrame, day: dt.date, col: str = "log_date") -> DataFrame:
    return df.filter(F.col(col) == F.lit(day))


def in_types(types: Sequence[int], col: str = "log_type") -> Column:
    return F.col(col).isin(*types)


def sums(*cols: str, prefix: str = "") -> list[Column]:
    """Sums that are 0, not NULL, for groups without values."""
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(prefix + c) for c in cols]


def mean(col: str, name: str, digits: int | None = 6) -> Column:
    """Average of the non-NULL values, rounded unless ``digits`` is None; NULL when there are none."""
    value = F.avg(col)
    return (value if digits is None else F.round(value, digits)).alias(name)


def mean_positive(col: str, name: str, digits: int = 6) -> Column:
    return F.round(F.avg(F.when(F.col(col) > 0, F.col(col))), digits).alias(name)


def count_rows(name: str = "cnt") -> Column:
    return F.count(F.lit(1)).alias(name)


def distinct(col: str, name: str) -> Column:
    return F.count_distinct(F.col(col)).alias(name)


def exact_div(num: str, den: str, name: str) -> Column:
    """Whole-number quotient, 0 when the divisor is 0."""
    return F.when(F.col(den) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"{num} div nullif({den}, 0)")).alias(name)
