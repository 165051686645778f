"""Dashboard widgets: distributions, top lists, series, samples and paged rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import keyset_page, page, share, top_n, with_overall, with_totals
from tidemark.functions.segmented import medians
from tidemark.operators.common import DIMS, between_ms, count_rows, exact_div, on_day, sums
from tidemark.operators.ingest import dedup_latest


def _half_even(num: Column, den: Column) -> Column:
    """Quotient rounded half to even as a whole number, 0 when there is nothing to divide by."""
    return F.when(den > 0, F.bround(num / F.when(den > 0, den), 0)).otherwise(0).cast("long")


def _hour_of_day(hour: str, day: dt.date) -> Column:
    return tg.utc_day(hour) == F.lit(day)


def model_totals(rollup: DataFrame, devices: DataFrame, day: dt.date, end: dt.date | None = None) -> DataFrame:
    """Sums and distinct devices of a day, or of days up to ``end``, by app and model.

    They come from the hourly rollup and its device table.
    """
    by = [*DIMS, "device_model"]
    inside = tg.in_days(tg.utc_day("hour_bucket"), day, end or day)
    counted = devices.filter(inside).groupBy(*by).agg(F.count_distinct("device_id").alias("device_count"))
    merged = rollup.filter(inside).groupBy(*by).agg(
        *sums("log_count", "error_count", "crash_count", "sum_cpu_usage", "sum_mem_usage")
    )
    return merged.join(counted, by, "left")


def device_distribution(rollup: DataFrame, devices: DataFrame, day: dt.date, n: int = 100) -> DataFrame:
    """Top models of each app with their share of its errors and crashes, and the app's totals."""
    rows = model_totals(rollup, devices, day).withColumnRenamed("log_count", "view_count")
    totals = rows.groupBy(*DIMS).agg(
        F.sum("device_count").alias("total_devices"), F.sum("view_count").alias("total_views"),
        F.sum("error_count").alias("total_errors"), F.sum("crash_count").alias("total_crashes"),
    )
    order = [F.col("view_count").desc(), F.col("error_count").desc(), F.col("crash_count").desc(), "device_model"]
    return top_n(rows, DIMS, order, n).join(totals, DIMS).select(
        *DIMS, "device_model", "device_count", "view_count", "error_count", "crash_count",
        share("error_count", "total_errors").alias("error_rate"), share("crash_count", "total_crashes").alias("crash_rate"),
        "total_devices", "total_views", "total_errors", "total_crashes",
    )


def device_list(
    rollup: DataFrame, devices: DataFrame, day: dt.date, limit: int, offset: int = 0, end: dt.date | None = None
) -> DataFrame:
    """One page of models by devices, one row more than asked when there is a next page."""
    rows = model_totals(rollup, devices, day, end).filter("device_model != ''").select(*DIMS, "device_model", "device_count", "log_count", "error_count", "crash_count")
    return page(rows, [F.col("device_count").desc(), "device_model", *DIMS], limit, offset)


def device_totals(rollup: DataFrame, devices: DataFrame, day: dt.date, end: dt.date | None = None) -> DataFrame:
    return model_totals(rollup, devices, day, end).groupBy(*DIMS).agg(
        count_rows("models"), *[F.sum(c).alias(c) for c in ("device_count", "log_count", "error_count", "crash_count")]
    )


def device_series(pages: DataFrame, start: dt.date, end: dt.date, grain: str = "hour") -> DataFrame:
    """Users, errors and crashes of each model per hour or day, every step present."""
    rows = pages.filter(tg.in_days("log_date", start, end))
    metrics = [F.count_distinct("device_id").alias("users"), *sums("error_count", "crash_count")]
    zero = {"users": 0, "error_count": 0, "crash_count": 0}
    if grain == "day":
        grouped = rows.groupBy("device_model", "log_date").agg(*metrics)
        return tg.zero_fill(grouped, "log_date", tg.day_steps(start, end), zero, ["device_model"])
    grouped = rows.groupBy("device_model", tg.bucket_ms("page_start_tm", tg.HOUR).alias("hour_ms")).agg(*metrics)
    steps = tg.ms_steps(tg.millis(start), tg.millis(end) + tg.DAY, tg.HOUR)
    return tg.zero_fill(grouped, "hour_ms", steps, zero, ["device_model"])


def _page_measures(merged: DataFrame) -> list[Column]:
    col = F.col
    return [
        col("cnt"), col("log_count"), col("sum_cpu_usage"), col("sum_mem_usage"),
        _half_even(col("sum_loading_time"), col("n_loading_time")).alias("loading_time"),
        _half_even(col("response_time"), col("request_count")).alias("response_time"),
        _half_even(col("sum_intervaltime"), col("n_intervaltime")).alias("intervaltime"),
        col("error_count"), col("crash_count"),
        _half_even(col("sum_cpu_usage"), col("log_count")).alias("cpu_usage"),
        _half_even(col("sum_mem_usage"), col("log_count")).alias("mem_usage"),
    ]


_PAGE_SUMS = ("cnt", "log_count", "error_count", "crash_count", "sum_mem_usage", "sum_cpu_usage", "response_time",
              "request_count", "sum_loading_time", "n_loading_time", "sum_intervaltime", "n_intervaltime")


def top_pages(rollup: DataFrame, day: dt.date, n: int = 30) -> DataFrame:
    """Most viewed pages of each app on a day, from the daily page rollup."""
    by = [*DIMS, "page_name"]
    rows = on_day(rollup, day).groupBy(*by).agg(*sums(*_PAGE_SUMS), F.sum("device_count").alias("device_count"))
    best = top_n(rows, DIMS, [F.col("cnt").desc(), "page_name"], n)
    return best.select(*by, *_page_measures(best), "device_count")


def page_list(rollup: DataFrame, start: dt.date, end: dt.date, limit: int, offset: int = 0) -> DataFrame:
    """One page of page names over days from ``start`` up to, not including, ``end``."""
    rows = rollup.filter((F.col("log_date") >= F.lit(start)) & (F.col("log_date") < F.lit(end))).filter("page_name != ''")
    merged = rows.groupBy("page_name").agg(*sums(*_PAGE_SUMS))
    return page(merged.select("page_name", *_page_measures(merged)), [F.col("cnt").desc(), "page_name"], limit, offset)


def page_series(pages: DataFrame, day: dt.date, page_name: str | None = None) -> DataFrame:
    """A day by the hour for each page: views, trouble, median loading, mean response; every hour present."""
    rows = on_day(pages, day)
    if page_name is not None:
        rows = rows.filter(F.col("page_name") == page_name)
    rows = rows.withColumn("hour_ms", tg.bucket_ms("page_start_tm", tg.HOUR))
    by = ["page_name", "hour_ms"]
    grouped = rows.groupBy(*by).agg(
        count_rows(), *sums("error_count", "crash_count"),
        F.bround(F.coalesce(F.avg("response_time"), F.lit(0.0)), 0).cast("long").alias("response"),
    )
    loading = medians(rows, by, "loading_time", "loading")
    both = grouped.join(loading, by, "left").withColumn("loading", F.bround(F.coalesce("loading", F.lit(0.0)), 0).cast("long"))
    start = tg.millis(day)
    zero = dict.fromkeys(("cnt", "error_count", "crash_count", "loading", "response"), 0)
    return tg.zero_fill(both, "hour_ms", tg.ms_steps(start, start + tg.DAY, tg.HOUR), zero, ["page_name"])


def page_series_daily(rollup: DataFrame, start: dt.date, end: dt.date, page_name: str | None = None) -> DataFrame:
    """A week or month by the day for each page, from the daily rollup; every day present."""
    rows = rollup.filter(tg.in_days("log_date", start, end))
    if page_name is not None:
        rows = rows.filter(F.col("page_name") == page_name)
    merged = rows.groupBy("page_name", "log_date").agg(*sums(*_PAGE_SUMS))
    grouped = merged.select(
        "page_name", "log_date", "cnt", "error_count", "crash_count",
        _half_even(F.col("sum_loading_time"), F.col("n_loading_time")).alias("loading"),
        _half_even(F.col("response_time"), F.col("request_count")).alias("response"),
    )
    zero = dict.fromkeys(("cnt", "error_count", "crash_count", "loading", "response"), 0)
    return tg.zero_fill(grouped, "log_date", tg.day_steps(start, end), zero, ["page_name"])


def merge_by_url(rows: DataFrame) -> DataFrame:
    """Per-OS page rows to one row per URL: sums, count-weighted means, usage per log.

    Device counts are summed as the dashboard does, so a device on two systems counts twice.
    """
    rows = rows.withColumn("page_name", F.trim("page_name")).filter("page_name != ''")
    weighted = [F.sum(F.col(c) * F.col("cnt")).alias(f"_{c}") for c in ("loading_time", "response_time", "intervaltime")]
    merged = rows.groupBy("page_name").agg(
        *sums("cnt", "log_count", "device_count", "sum_cpu_usage", "sum_mem_usage", "error_count", "crash_count"), *weighted
    )
    return merged.select(
        "page_name", "cnt", "log_count", "device_count", "sum_cpu_usage", "sum_mem_usage", "error_count", "crash_count",
        *[_half_even(F.col(f"_{c}"), F.col("cnt")).alias(c) for c in ("loading_time", "response_time", "intervaltime")],
        _half_even(F.col("sum_cpu_usage"), F.col("log_count")).alias("cpu_usage"),
        _half_even(F.col("sum_mem_usage"), F.col("log_count")).alias("mem_usage"),
    ).orderBy(F.col("cnt").desc(), "page_name")


def priority_pages(rollup: DataFrame, day: dt.date, each: int = 15, limit: int = 30) -> DataFrame:
    """Crash pages, then error pages, then logged pages, at most ``limit`` and always one logged page."""
    by = [*DIMS, "page_name"]
    counts = on_day(rollup, day).filter("page_name != ''").groupBy(*by).agg(*sums("crash_count", "error_count", "log_count"))
    parts = []
    for kind, col, n in ((2, "crash_count", each), (1, "error_count", each), (0, "log_count", limit)):
        some = counts.filter(F.col(col) > 0).select(*by, F.col(col).alias("cnt"), F.lit(kind).alias("type"))
        parts.append(top_n(some, DIMS, [F.col("cnt").desc(), F.col("page_name").desc()], n, rank="rank"))
    listed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # At most 2 * each + limit rows per app from here on.
    order = Window.partitionBy(*DIMS).orderBy(F.col("type").desc(), "rank")
    trouble = F.count_if(F.col("type") > 0).over(Window.partitionBy(*DIMS))
    placed = listed.withColumn("_pos", F.row_number().over(order)).withColumn("_trouble", trouble)
    full = F.col("_trouble") >= limit
    logged = F.col("type") == 0
    pos = F.when(full & logged, F.when(F.col("rank") == 1, F.lit(limit))).when(
        full & (F.col("_pos") >= limit) & _has_log(), F.lit(None)
    ).otherwise(F.col("_pos"))
    return placed.withColumn("position", pos).filter(F.col("position") <= limit).select(*by, "cnt", "type", "position")


def _has_log() -> Column:
    return F.count_if(F.col("type") == 0).over(Window.partitionBy(*DIMS)) > 0


def page_view_series(pages: DataFrame, start_ms: int, end_ms: int, grain: str = "hour", page_name: str | None = None, tz: str = "UTC") -> DataFrame:
    """Views and distinct viewers of each page per hour or day."""
    rows = between_ms(pages, "page_start_tm", start_ms, end_ms)
    if page_name is not None:
        rows = rows.filter(F.col("page_name") == page_name)
    bucket = tg.hour_of("page_start_tm", tz) if grain == "hour" else tg.day_of("page_start_tm", tz)
    return rows.groupBy("page_name", bucket.alias("bucket")).agg(count_rows("views"), F.count_distinct("device_id").alias("viewers"))


def resource_top(rollup: DataFrame, devices: DataFrame, day: dt.date, n: int = 6) -> DataFrame:
    """Models with the most users of each app, with mean CPU (one decimal) and memory per log."""
    rows = model_totals(rollup, devices, day).filter("device_model != ''")
    best = top_n(rows, DIMS, [F.col("device_count").desc(), "device_model"], n)
    logs = F.col("log_count")
    return best.select(
        *DIMS, "device_model", "device_count", "log_count",
        F.when(logs > 0, F.bround(F.col("sum_cpu_usage") / F.when(logs > 0, logs), 1)).otherwise(0.0).alias("cpu_usage"),
        _half_even(F.col("sum_mem_usage"), logs).alias("mem_usage"),
    )


def resource_series(rollup: DataFrame, devices: DataFrame, day: dt.date, n: int = 6, tail: int | None = None) -> DataFrame:
    """Hourly whole-number CPU and memory per log of the top models, optionally the last points only."""
    top = resource_top(rollup, devices, day, n).select(*DIMS, "device_model")
    by = [*DIMS, "device_model", "hour_bucket"]
    rows = rollup.filter(_hour_of_day("hour_bucket", day)).join(top, [*DIMS, "device_model"], "left_semi")
    hourly = rows.groupBy(*by).agg(*sums("log_count", "sum_cpu_usage", "sum_mem_usage")).select(
        *by, "log_count", exact_div("sum_cpu_usage", "log_count", "avg_cpu_usage"), exact_div("sum_mem_usage", "log_count", "avg_mem_usage"),
    )
    return hourly if tail is None else top_n(hourly, [*DIMS, "device_model"], [F.col("hour_bucket").desc()], tail)


def resource_models(rollup: DataFrame, devices: DataFrame, day: dt.date, limit: int, offset: int = 0) -> DataFrame:
    """One page of models by users, with totals over all models on each row."""
    rows = model_totals(rollup, devices, day).filter("device_model != ''")
    totals = {"total_count": F.sum("device_count"), "total_log_count": F.sum("log_count"), "total_rows": F.count(F.lit(1))}
    shown = page(
        rows.select(*DIMS, "device_model", "device_count", "log_count", "sum_cpu_usage", "sum_mem_usage"),
        [F.col("device_count").desc(), "device_model", *DIMS], limit, offset,
    )
    return with_overall(shown, rows, totals)


def resource_join(pages: DataFrame, access: DataFrame) -> DataFrame:
    """Mean CPU and memory of each model beside its users; models need both."""
    usage = pages.groupBy("device_model").agg(
        F.round(F.avg("sum_cpu_usage"), 6).alias("cpu_usage"), F.round(F.avg("sum_mem_usage"), 6).alias("mem_usage"), count_rows("usage_count")
    )
    users = access.groupBy("device_model").agg(F.count_distinct("device_id").alias("users"))
    return usage.join(users, "device_model")


def pv_list(rollup: DataFrame, devices: DataFrame, start: dt.date, end: dt.date, limit: int, offset: int = 0) -> DataFrame:
    """Views, distinct devices and mean stay by page over a range of days."""
    inside = tg.in_days("log_date", start, end) & (F.col("page_name") != "")
    views = rollup.filter(inside).groupBy("page_name").agg(*sums("log_count", "sum_intervaltime", "n_intervaltime"))
    seen = devices.filter(inside).groupBy("page_name").agg(F.count_distinct("device_id").alias("device_count"))
    stay = F.round(F.col("sum_intervaltime") / F.nullif(F.col("n_intervaltime"), F.lit(0)), 6)
    rows = views.join(seen, "page_name").select("page_name", F.col("log_count").alias("view_count"), "device_count", stay.alias("intervaltime"))
    return page(rows, [F.col("view_count").desc(), "page_name"], limit, offset, probe=False)


def pv_detail(pages: DataFrame, start_ms: int, end_ms: int, page_name: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest visits of a page."""
    rows = between_ms(pages, "page_start_tm", start_ms, end_ms).filter(F.col("page_name") == page_name)
    return page(
        rows.select("page_start_tm", "device_id", "user_id", "intervaltime", "loading_time"),
        [F.col("page_start_tm").desc(), "device_id"], limit, offset, probe=False,
    )


def pv_chart(pages: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Hourly mean stay and loading of each page."""
    rows = between_ms(pages, "page_start_tm", start_ms, end_ms)
    return rows.groupBy("page_name", tg.bucket_ms("page_start_tm", tg.HOUR).alias("hour_ms")).agg(
        F.round(F.avg("intervaltime"), 6).alias("stay_time"), F.round(F.avg("loading_time"), 6).alias("loading_time")
    )


def trouble_list(
    trouble: DataFrame, kind: int, limit: int, page_name: str | None = None, os_type: str | None = None, model: str | None = None
) -> DataFrame:
    """Newest crashes when the crash code is asked for, else newest other trouble; one row more than asked."""
    crash = F.col("log_type") == lt.CRASH
    rows = trouble.filter(crash if kind == lt.CRASH else ~crash)
    for col, value in (("req_url", page_name), ("os_type", os_type), ("device_model", model)):
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    return page(rows, [F.col("log_tm").desc(), "device_id", "log_type"], limit)


def row_detail(df: DataFrame, keys: Sequence[str], version: str, wanted: DataFrame | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows by natural key, the latest version of each; all keys, or those of a key frame."""
    if wanted is not None:
        df = df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return dedup_latest(df, keys, version, tiebreak)


def scatter_sample(
    df: DataFrame, metric: str, ts: str, ids: Sequence[str], mode: str = "all", slow_ms: int = 1500, cap: int = 2000,
    elapsed_s: float = 300.0, seed: int = 0, by: Sequence[str] = ("package_nm", "server_type"),
) -> DataFrame:
    """Every slow row, and at most ``cap`` others per app.

    ``all`` takes a seeded sample by hash order, the same on every run. ``latest`` takes the newest,
    fewer when less time has passed.
    """
    slow = df.filter(F.col(metric) >= slow_ms)
    rest = df.filter(F.col(metric) < slow_ms)
    if mode == "all":
        order = [F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]), *ids]
        n = cap
    else:
        order = [F.col(ts).desc(), *ids]
        n = max(1, int(cap * max(elapsed_s, 1.0) / 300.0))
    return slow.unionByName(top_n(rest, by, order, n))


def merge_increment(old: DataFrame, new: DataFrame, keys: Sequence[str], ts: str, keep_from: Column) -> tuple[DataFrame, DataFrame]:
    """(rows only the new batch has, merged state). New values win; state older than ``keep_from`` is dropped."""
    keys = list(keys)
    fresh = new.join(old.select(*keys), keys, "left_anti")
    values = [c for c in new.columns if c not in keys]
    renamed = old.withColumnsRenamed({c: f"_old_{c}" for c in values})
    merged = new.join(renamed, keys, "full").select(*keys, *[F.coalesce(c, f"_old_{c}").alias(c) for c in values])
    return fresh, merged.filter(F.col(ts) >= keep_from)


def scatter_since(df: DataFrame, cursor_ms: int, ids: Sequence[str], os_type: str | None = None, ts: str = "log_tm") -> DataFrame:
    """Rows after a cursor, with a row id made of the natural key."""
    rows = between_ms(df, ts, cursor_ms + 1, None)
    if os_type is not None:
        rows = rows.filter(F.col("os_type") == os_type)
    return rows.withColumn("row_id", F.concat_ws("_", *[F.col(c).cast("string") for c in ids]))


def device_analysis(access: DataFrame, pages: DataFrame) -> DataFrame:
    """Users of each model with its OS, its errors and crashes, and totals over all models."""
    users = access.groupBy("device_model").agg(F.count_distinct("device_id").alias("users"), F.min("os_type").alias("os_type"))
    trouble = pages.groupBy("device_model").agg(*sums("error_count", "crash_count"))
    rows = users.join(trouble, "device_model", "left").fillna(0, ["error_count", "crash_count"])
    return with_totals(rows, {c: f"total_{c}" for c in ("users", "error_count", "crash_count")})


def trouble_by_location(
    trouble: DataFrame, day: dt.date, kind: str, code: str | None = None, limit: int = 50, offset: int = 0, col: str = "location_code"
) -> DataFrame:
    """The day before's errors or crashes of a location, newest first."""
    rows = on_day(trouble, day - dt.timedelta(days=1))
    rows = rows.filter(F.col("log_type") == lt.CRASH if kind == "crash" else F.col("log_type").isin(*lt.ERROR))
    if code is not None:
        rows = rows.filter(F.col(col) == code)
    return page(rows, [F.col("log_tm").desc(), "device_id"], limit, offset, probe=False)


def other_bucket(df: DataFrame, key: str, by: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Rows and distinct devices whose key is set but not among the largest of its group."""
    known = df.filter(F.coalesce(key, F.lit("")) != "")
    counts = known.groupBy(*by, key).agg(F.count_distinct("device_id").alias("_n"))
    best = top_n(counts, list(by), [F.col("_n").desc(), key], top) if by else counts.orderBy(F.col("_n").desc(), key).limit(top)
    rest = known.join(best.select(*by, key), [*by, key], "left_anti")
    return rest.groupBy(*by).agg(count_rows(), F.count_distinct("device_id").alias("devices"))


def urls_without_alias(pages: DataFrame, alias: DataFrame, day: dt.date, n: int = 20) -> DataFrame:
    """The day's most viewed page URLs that have no alias."""
    open_urls = on_day(pages, day).groupBy("page_name").agg(count_rows()).join(alias.select("page_name").distinct(), "page_name", "left_anti")
    return open_urls.orderBy(F.col("cnt").desc(), "page_name").limit(n)


def with_display_names(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str) -> DataFrame:
    """Add a display name, the raw value where there is none.

    The name table is joined without a hint: Spark broadcasts it only under its own size threshold.
    """
    unique = names.groupBy(F.col(name_key).alias("_key")).agg(F.max(name).alias("_name"))
    joined = df.join(unique, df[key] == unique["_key"], "left")
    return joined.withColumn(out, F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col(key))).drop("_key", "_name")


def trouble_by_page(trouble: DataFrame, page_name: str, kind: str, size: int, after: Sequence[object] | None = None, col: str = "page_name") -> DataFrame:
    """Newest error or crash rows of a page after a (time, device, type) key."""
    types = (lt.CRASH,) if kind == "crash" else lt.ERROR
    rows = trouble.filter((F.col(col) == page_name) & F.col("log_type").isin(*types))
    return keyset_page(rows, [("log_tm", True), ("device_id", True), ("log_type", True)], size, after)
