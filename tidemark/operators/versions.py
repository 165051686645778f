"""App versions and trouble reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import literal_frame, share, with_total
from tidemark.functions.segmented import medians, percentiles
from tidemark.operators.common import count_rows, mean, sums

OS_VER = ["os_type", "app_ver"]


def _whole_percent(part: str, whole: str) -> Column:
    """Percent rounded half up to a whole number, 0 when the whole is empty."""
    p, w = F.col(part), F.col(whole)
    return F.when(w > 0, F.floor(p / F.when(w > 0, w) * 100 + 0.5)).otherwise(0).cast("long")


def version_compare(pages: DataFrame, access: DataFrame, versions: Sequence[tuple[str, str]]) -> DataFrame:
    """Usage, trouble, mean times and users of given (OS, version) pairs; zeros for a pair never seen."""
    asked = literal_frame(pages.sparkSession, list(dict.fromkeys(versions)), OS_VER)
    info = pages.filter(F.col("log_type") != lt.APP_START).groupBy(*OS_VER).agg(
        *sums("sum_cpu_usage", "sum_mem_usage", "log_count", "error_count", "crash_count"),
        mean("loading_time", "loading_time"), mean("response_time", "response_time"),
    )
    users = access.groupBy(*OS_VER).agg(F.count_distinct("device_id").alias("users"))
    counters = ["sum_cpu_usage", "sum_mem_usage", "log_count", "error_count", "crash_count", "users"]
    return asked.join(info, OS_VER, "left").join(users, OS_VER, "left").fillna(0, counters).fillna(0.0, ["loading_time", "response_time"])


def all_versions(access: DataFrame, pages: DataFrame, network: DataFrame) -> DataFrame:
    """Users, installs, median loading, trouble and mean response of every OS and version."""
    users = access.groupBy(*OS_VER).agg(count_rows("users"), F.count_if(F.col("install_yn") == "Y").alias("installs"))
    trouble = pages.groupBy(*OS_VER).agg(*sums("error_count", "crash_count"))
    response = network.groupBy(*OS_VER).agg(mean("intervaltime", "response_time"))
    return (
        users.join(trouble, OS_VER, "left").join(medians(pages, OS_VER, "loading_time", "loading_time"), OS_VER, "left")
        .join(response, OS_VER, "left").fillna(0, ["error_count", "crash_count"])
    )


def version_series(access: DataFrame, trouble: DataFrame, pages: DataFrame, network: DataFrame, grain: str = "day", tz: str = "UTC") -> DataFrame:
    """Users, troubled devices, median loading and mean response of each OS and version per hour or day."""
    cut = tg.hour_of if grain == "hour" else tg.day_of
    by = [*OS_VER, "bucket"]

    def timed(df: DataFrame, ts: str) -> DataFrame:
        return df.withColumn("bucket", cut(ts, tz))

    users = timed(access, "app_start_tm").groupBy(*by).agg(F.count_distinct("device_id").alias("users"))
    troubled = timed(trouble, "log_tm").groupBy(*by).agg(F.count_distinct("device_id").alias("troubled"))
    loading = medians(timed(pages, "page_start_tm"), by, "loading_time", "loading_time")
    response = timed(network, "log_tm").groupBy(*by).agg(mean("intervaltime", "response_time"))
    joined = users.join(troubled, by, "full").join(loading, by, "full").join(response, by, "full")
    return joined.fillna(0, ["users", "troubled"]).fillna(0.0, ["loading_time", "response_time"])


def version_conversion(access: DataFrame, trouble: DataFrame, top: int = 5) -> DataFrame:
    """Users, errors and crashes of each OS by version with whole-percent shares: the top versions, then Others."""
    crash = F.col("log_type") == lt.CRASH
    users = access.groupBy(*OS_VER).agg(count_rows("user"))
    bad = trouble.groupBy(*OS_VER).agg(F.count_if(~crash).alias("error"), F.count_if(crash).alias("crash"))
    rows = users.join(bad, OS_VER, "left").fillna(0, ["error", "crash"])
    # One row a version: the rank, and the totals over what is left after merging, are windows over a small frame.
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("os_type").orderBy(F.col("user").desc(), "app_ver")))
    shown = F.when(F.col("_rank") <= top, F.col("app_ver")).otherwise(F.lit("Others"))
    counts = ("user", "error", "crash")
    merged = ranked.groupBy("os_type", shown.alias("app_ver")).agg(*[F.sum(c).alias(c) for c in counts])
    merged = merged.withColumns({f"_{c}": F.sum(c).over(Window.partitionBy("os_type")) for c in counts})
    return merged.select(
        "os_type", "app_ver", "user", _whole_percent("user", "_user").alias("user_rate"), "error",
        _whole_percent("error", "_error").alias("error_rate"), "crash", _whole_percent("crash", "_crash").alias("crash_rate"),
    )


def version_daily_share(access: DataFrame) -> DataFrame:
    """Daily rows of each version with the share of its OS and day."""
    daily = access.groupBy("log_date", *OS_VER).agg(count_rows())
    return with_total(daily, "cnt", "_all", ["log_date", "os_type"]).select("log_date", *OS_VER, "cnt", share("cnt", "_all", 1).alias("rate"))


def crash_by_version(access: DataFrame, pages: DataFrame) -> DataFrame:
    """Users and crashes by OS and version; crash share of all crashes with one decimal."""
    users = access.groupBy(*OS_VER).agg(count_rows("user"))
    crashes = with_total(pages.groupBy(*OS_VER).agg(*sums("crash_count")), "crash_count", "_all")
    rate = F.floor(F.col("crash_count") / F.nullif(F.col("_all"), F.lit(0)) * 1000 + 0.5) / 10
    crashes = crashes.select(*OS_VER, "crash_count", F.coalesce(rate, F.lit(0.0)).alias("crash_rate"))
    return users.join(crashes, OS_VER, "full").fillna(0, ["user", "crash_count"]).fillna(0.0, ["crash_rate"]).orderBy(*OS_VER)


def version_report(pages: DataFrame, start: dt.date, end: dt.date, by_version: bool = True, tz: str = "UTC") -> DataFrame:
    """Per day, and per OS and version when asked: views, users, mean times and usage, trouble."""
    day = tg.day_of("page_start_tm", tz).alias("day")
    rows = pages.filter(F.col("log_date").between(F.lit(start - dt.timedelta(days=1)), F.lit(end))).withColumn("day", day)
    return rows.filter(tg.in_days("day", start, end)).groupBy("day", *(OS_VER if by_version else [])).agg(
        count_rows("pv"), F.count_distinct("device_id").alias("users"), mean("response_time", "response_time"),
        mean("loading_time", "loading_time"), mean("sum_cpu_usage", "cpu_usage"), mean("sum_mem_usage", "mem_usage"),
        *sums("error_count", "crash_count"),
    )


def _report(rows: DataFrame, content: Column, name: str) -> DataFrame:
    """Rows of known users by content, OS, type, version, time and user."""
    known = rows.filter(~F.coalesce(F.col("user_id"), F.lit("")).isin("", "-"))
    return known.groupBy(content.alias(name), "os_type", "log_type", "app_ver", "log_tm", "user_id").agg(count_rows())


def trouble_report(trouble: DataFrame, message: str = "log_name", types: Sequence[int] = lt.ERROR) -> DataFrame:
    """Errors by message, OS, type, version, time and user; known users only."""
    return _report(trouble.filter(F.col("log_type").isin(*types)), F.col(message), message)


def crash_report(trouble: DataFrame, stack: str = "res_msg", types: Sequence[int] = (lt.CRASH,)) -> DataFrame:
    """Crashes by the first line of their stack, OS, type, version, time and user; known users only."""
    first = F.trim(F.split_part(F.col(stack), F.lit("\n"), F.lit(1)))
    return _report(trouble.filter(F.col("log_type").isin(*types)), first, "occurrence")


def latest_of_report(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """A report without time and user: rows, the latest time and its user."""
    return report.groupBy(*by).agg(
        F.sum("cnt").alias("cnt"), F.max("log_tm").alias("last_tm"), F.max_by("user_id", F.struct("log_tm", "user_id")).alias("last_user")
    )


def response_summary(df: DataFrame, metric: str) -> DataFrame:
    """Per version calls, share of all calls, largest, median and smallest time."""
    rows = df.filter(F.col(metric).isNotNull())
    ends = rows.groupBy(*OS_VER).agg(F.max(metric).alias("max_value"), F.min(metric).alias("min_value"))
    middle = percentiles(rows, OS_VER, metric, {"med_value": 0.5}).withColumnRenamed("n", "cnt")
    both = with_total(ends.join(middle, OS_VER), "cnt", "_all")
    return both.withColumn("rate", share("cnt", "_all")).drop("_all")


def top_trouble_devices(pages: DataFrame, kind: str = "error_count", n: int = 10) -> DataFrame:
    """Models with the most errors or crashes, with devices and OS."""
    rows = pages.groupBy("device_model").agg(
        *sums(kind), F.count_distinct("device_id").alias("users"), F.max("os_type").alias("os_type")
    )
    return rows.orderBy(F.col(kind).desc(), "device_model").limit(n)


def page_report(pages: DataFrame, n: int = 20) -> DataFrame:
    """Most viewed pages with viewers, mean stay and loading, trouble."""
    rows = pages.groupBy("page_name").agg(
        count_rows("views"), F.count_distinct("device_id").alias("viewers"), mean("intervaltime", "stay"),
        mean("loading_time", "loading_time"), *sums("error_count", "crash_count"),
    )
    return rows.orderBy(F.col("views").desc(), "page_name").limit(n)


def message_groups(trouble: DataFrame, message: str = "log_name", n: int = 10) -> DataFrame:
    """Messages with the most rows, and the log types they came as."""
    by_type = trouble.groupBy(message, "log_type").agg(count_rows("_n"))
    # A message has a handful of log types, which bounds the list.
    grouped = by_type.groupBy(message).agg(
        F.sum("_n").alias("cnt"), F.sort_array(F.collect_set("log_type")).alias("log_types")
    )
    return grouped.orderBy(F.col("cnt").desc(), message).limit(n)
