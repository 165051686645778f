"""Device lifecycle, retention and daily status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import top_n
from tidemark.operators.common import count_rows

_ACTIVE = "active_st = 'Y'"
_NORMAL = f"{_ACTIVE} AND device_st IN ('N', 'R') AND reinstalled_date IS NULL"

# Lifecycle states as conditions on the device record.
STATES = {
    "total": "true",
    "active": _ACTIVE,
    "normal": _NORMAL,
    "dormant": "active_st = 'N' AND device_st = 'S' AND sleep_date IS NOT NULL",
    "inactive": "active_st = 'N'",
    "reinstalled": f"{_ACTIVE} AND reinstalled_date IS NOT NULL",
    "deleted": "deleted_date IS NOT NULL",
    "vip": f"{_NORMAL} AND vip_yn = 'Y'",
    "non_vip": f"{_NORMAL} AND vip_yn = 'N'",
}


def device_lifecycle(devices: DataFrame, by: Sequence[str] = ("package_nm", "server_type")) -> DataFrame:
    """Devices in each state, in one pass."""
    return devices.groupBy(*by).agg(*[F.count_if(F.expr(cond)).alias(name) for name, cond in STATES.items()])


def device_growth(devices: DataFrame, state: str, by: Sequence[str] = ("package_nm", "server_type")) -> DataFrame:
    """New devices of a state per day and their running total, days without any included.

    A group has one row per day, which bounds the window.
    """
    by = list(by)
    daily = devices.filter(F.expr(STATES[state])).groupBy(*by, "created_date").agg(count_rows())
    bounds = daily.groupBy(*by).agg(F.min("created_date").alias("_lo"), F.max("created_date").alias("_hi"))
    grid = bounds.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("created_date"))
    filled = grid.join(daily, [*by, "created_date"], "left").fillna(0, ["cnt"])
    upto = Window.partitionBy(*by).orderBy("created_date").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("total", F.sum("cnt").over(upto))


def lifecycle_users(devices: DataFrame, state: str) -> DataFrame:
    return devices.filter(F.expr(STATES[state]))


def retention(visits: DataFrame, start: dt.date, end: dt.date, by: Sequence[str] = ("package_nm", "server_type")) -> DataFrame:
    """Rows of each day by retention day; the first day is 1, so 2 and later are revisits."""
    return visits.filter(tg.in_days("log_date", start, end)).groupBy(*by, "log_date", "retention_day").agg(
        count_rows(), F.when(F.col("retention_day") >= 2, "Y").otherwise("N").alias("revisit")
    )


def access_counts(visits: DataFrame, start: dt.date, end: dt.date, by: Sequence[str] = ("package_nm", "server_type")) -> DataFrame:
    """Distinct connects, login and other rows, and mean use time of a range."""
    return visits.filter(tg.in_days("log_date", start, end)).groupBy(*by).agg(
        F.count_distinct("device_id").alias("connects"),
        F.count_if(F.col("login_yn") == "Y").alias("logins"), F.count_if(F.col("login_yn") != "Y").alias("not_logins"),
        F.round(F.avg("using_time"), 6).alias("avg_using_time"),
    )


def use_time_distribution(visits: DataFrame, step_ms: int, by: Sequence[str] = ("package_nm", "server_type")) -> DataFrame:
    """Rows by use time bucket."""
    return visits.groupBy(*by, (F.floor(F.col("using_time") / step_ms) * step_ms).cast("long").alias("bucket")).agg(count_rows())


def daily_use_time(visits: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Mean use time of each day, every day present."""
    daily = visits.filter(tg.in_days("log_date", start, end)).groupBy("log_date").agg(F.round(F.avg("using_time"), 6).alias("avg_using_time"))
    return tg.zero_fill(daily, "log_date", tg.day_steps(start, end), {"avg_using_time": 0.0})


def sleep_counts(devices: DataFrame, start: dt.date, end: dt.date, by: Sequence[str] = ("package_nm", "server_type")) -> DataFrame:
    """Devices that fell asleep in a range."""
    asleep = devices.filter(F.col("device_st") == "S").filter(tg.in_days("sleep_date", start, end))
    return asleep.groupBy(*by).agg(count_rows("sleeps"))


def models_by_os(events: DataFrame, os_type: str | None = None, n: int = 10) -> DataFrame:
    """Models with the most devices of each OS, or of one."""
    rows = events if os_type is None else events.filter(F.col("os_type") == os_type)
    counts = rows.groupBy("os_type", "device_model").agg(F.count_distinct("device_id").alias("devices"))
    return top_n(counts, ["os_type"], [F.col("devices").desc(), "device_model"], n)


def _trouble(kind: str) -> Column:
    return F.count_if(F.col("log_type") == lt.CRASH if kind == "crash" else F.col("log_type") != lt.CRASH)


def status_series(visits: DataFrame, devices: DataFrame, pages: DataFrame, trouble: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per day connects, installs, logins, revisits, sleeps, page uses, errors, crashes and mean use time; every day present."""
    inside = tg.in_days("log_date", start, end)
    parts = [
        visits.filter(inside).groupBy("log_date").agg(
            F.count_distinct("device_id").alias("connect"), F.count_if(F.col("install_yn") == "Y").alias("install"),
            F.count_if(F.col("login_yn") == "Y").alias("login"), F.count_if(F.col("retention_day") >= 2).alias("reconnect"),
            F.round(F.avg("using_time"), 6).alias("avg_use_time"),
        ),
        devices.filter(F.col("device_st") == "S").withColumn("log_date", F.col("sleep_date")).filter(inside).groupBy("log_date").agg(count_rows("sleep")),
        pages.filter(inside).groupBy("log_date").agg(count_rows("use")),
        trouble.filter(inside).groupBy("log_date").agg(_trouble("error").alias("error"), _trouble("crash").alias("crash")),
    ]
    joined = tg.calendar(visits.sparkSession, start, end, "day", "log_date")
    for part in parts:
        joined = joined.join(part, "log_date", "left")
    return joined.fillna(0, [c for c in joined.columns if c not in ("log_date", "avg_use_time")]).fillna(0.0, ["avg_use_time"])


def period_bi(visits: DataFrame, devices: DataFrame, pages: DataFrame, trouble: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Counts of a range by app: installs, deletes, logins, sleeps, uses, users, trouble, and use time without zeros."""
    by = ["package_nm", "server_type"]
    inside = tg.in_days("log_date", start, end)
    used = F.nullif(F.col("using_time"), F.lit(0))
    parts = [
        visits.filter(inside).groupBy(*by).agg(
            F.count_if(F.col("install_yn") == "Y").alias("installs"), F.count_if(F.col("login_yn") == "Y").alias("logins"),
            F.count_distinct("device_id").alias("users"), F.min(used).alias("min_use_time"),
            F.round(F.avg(used), 6).alias("avg_use_time"), F.max(used).alias("max_use_time"),
        ),
        devices.groupBy(*by).agg(
            F.count_if(tg.in_days("deleted_date", start, end)).alias("deletes"),
            F.count_if((F.col("device_st") == "S") & tg.in_days("sleep_date", start, end)).alias("sleeps"),
        ),
        pages.filter(inside).groupBy(*by).agg(count_rows("uses")),
        trouble.filter(inside).groupBy(*by).agg(_trouble("error").alias("errors"), _trouble("crash").alias("crashes")),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, by, "full")
    return joined.fillna(0, [c for c in joined.columns if c not in by and not c.endswith("use_time")])
