"""Performance analytics: time buckets, histograms, percentiles, network errors, searches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import text
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import after_key, keyset_page, with_overall, with_total
from tidemark.functions.segmented import medians, percentiles
from tidemark.operators.common import between_ms, count_rows, mean, mean_positive, on_day, sums

INTERVALS = {"30s": 30_000, "1m": tg.MINUTE, "5m": 5 * tg.MINUTE, "10m": 10 * tg.MINUTE, "30m": 30 * tg.MINUTE, "1h": tg.HOUR, "1d": tg.DAY}


def _series(
    rows: DataFrame, ts: str, width: int, aggs: Sequence[Column], start_ms: int, end_ms: int, fill: Mapping[str, object] | None,
    by: Sequence[str] = (),
) -> DataFrame:
    inside = between_ms(rows, ts, start_ms, end_ms)
    grouped = inside.groupBy(*by, tg.bucket_ms(ts, width).alias("bucket_ms")).agg(*aggs)
    if fill is None:
        return grouped
    return tg.zero_fill(grouped, "bucket_ms", tg.ms_steps(start_ms, end_ms, width), fill, by)


def minute_trend(pages: DataFrame, kind: str, start_ms: int, end_ms: int, interval: str = "1m", fill: bool = True) -> DataFrame:
    """Rows, crashes or errors per interval."""
    agg = {"count": F.count(F.lit(1)), "crash": F.sum("crash_count"), "error": F.sum("error_count")}[kind]
    zero = {"cnt": 0} if fill else None
    return _series(pages, "page_start_tm", INTERVALS[interval], [agg.alias("cnt")], start_ms, end_ms, zero)


def minute_stats(df: DataFrame, metric: str, ts: str, start_ms: int, end_ms: int, total: bool = False) -> DataFrame:
    """Smallest, mean (or summed) and largest positive value per minute, with the count."""
    middle = F.sum(metric).alias("sum_value") if total else F.round(F.avg(metric), 6).alias("avg_value")
    aggs = [F.min(metric).alias("min_value"), middle, F.max(metric).alias("max_value"), count_rows()]
    return _series(df.filter(F.col(metric) > 0), ts, tg.MINUTE, aggs, start_ms, end_ms, None)


def url_model_stats(
    df: DataFrame, metric: str, limit: int, after: Sequence[str] | None = None, url: str = "page_name", median: bool = False
) -> DataFrame:
    """Count, smallest, mean and largest value by URL and model after a (URL, model) key."""
    rows = df.filter(F.col(metric) > 0)
    order = [(url, False), ("device_model", False)]
    if after is not None:
        rows = rows.filter(after_key(order, after))
    stats = rows.groupBy(url, "device_model").agg(
        count_rows(), F.min(metric).alias("min_value"), mean(metric, "avg_value"), F.max(metric).alias("max_value")
    )
    shown = keyset_page(stats, order, limit)
    if not median:
        return shown
    return shown.join(medians(rows, [url, "device_model"], metric, "med_value"), [url, "device_model"], "left")


def slowest_models(df: DataFrame, metric: str, n: int, os_type: str | None = None) -> DataFrame:
    """Models with the largest mean."""
    rows = df if os_type is None else df.filter(F.col("os_type") == os_type)
    means = rows.filter(F.col(metric) > 0).groupBy("device_model").agg(mean(metric, "avg_value"), count_rows())
    return means.orderBy(F.col("avg_value").desc(), "device_model").limit(n)


def pv_urls(pages: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Per URL rows, distinct devices and time sums."""
    return between_ms(pages, "page_start_tm", start_ms, end_ms).groupBy("page_name").agg(
        count_rows(), F.count_distinct("device_id").alias("devices"), *sums("response_time", "request_count", "loading_time", "intervaltime")
    )


def log_filter(
    types: Sequence[int] | None = None, versions: Mapping[str, Sequence[str]] | None = None,
    fields: Mapping[str, tuple[str, str]] | None = None,
) -> Column:
    """Search predicate: log types, version lists per OS (any may match), fields (``exact`` or ``contains``)."""
    cond = F.lit(True)
    if types:
        cond = cond & F.col("log_type").isin(*types)
    if versions:
        some = F.lit(False)
        for os_name, listed in versions.items():
            some = some | ((F.col("os_type") == os_name) & F.col("app_ver").isin(*listed))
        cond = cond & some
    for name, (how, value) in (fields or {}).items():
        match = F.col(name) == value if how == "exact" else F.contains(F.lower(F.col(name)), F.lit(value.lower()))
        cond = cond & match
    return cond


SEARCH_ORDER = (("log_tm", True), ("device_id", True), ("log_type", True))


def log_search(
    events: DataFrame, start_ms: int, end_ms: int, size: int, cond: Column | None = None, after: Sequence[object] | None = None
) -> DataFrame:
    """Newest matching rows, or the page after a (time, device, type) key."""
    rows = between_ms(events, "log_tm", start_ms, end_ms)
    if cond is not None:
        rows = rows.filter(cond)
    return keyset_page(rows, SEARCH_ORDER, size, after)


def url_model_rows(df: DataFrame, url: str, model: str, ts: str, size: int, col: str = "page_name") -> DataFrame:
    """Newest rows of one URL and model."""
    rows = df.filter((F.col(col) == url) & (F.col("device_model") == model))
    return rows.orderBy(F.col(ts).desc(), "device_id").limit(size)


def heatmap(df: DataFrame, metric: str, ts: str, start_ms: int, end_ms: int, minutes: int, step: int) -> DataFrame:
    """Row count by time bucket and duration bucket; the axis reaches at least 2,000 ms."""
    rows = between_ms(df, ts, start_ms, end_ms + 1).filter(F.col(metric).isNotNull())
    cells = rows.groupBy(
        tg.bucket_ms(ts, minutes * tg.MINUTE).alias("bucket_ms"), (F.floor(F.col(metric) / step) * step).cast("long").alias("duration")
    ).agg(count_rows())
    highest = F.greatest(F.coalesce(F.max("duration"), F.lit(0)), F.lit(2000)).cast("long")
    return with_overall(cells, cells, {"max_duration": highest})


def in_cell(df: DataFrame, metric: str, ts: str, start_ms: int, end_ms: int, low: int, high: int) -> DataFrame:
    """Rows of a rectangle of the heat map, all sides kept."""
    return between_ms(df, ts, start_ms, end_ms + 1).filter(F.col(metric).between(low, high))


def heatmap_urls(cell: DataFrame, metric: str, limit: int, url: str = "page_name") -> DataFrame:
    """Per URL mean duration, rows and errors inside a cell."""
    return (
        cell.groupBy(url).agg(mean(metric, "avg_value"), count_rows(), *sums("error_count"))
        .orderBy(F.col("cnt").desc(), url).limit(limit)
    )


def perf_rows(cell: DataFrame, ts: str, limit: int, url: str | None = None, col: str = "page_name") -> DataFrame:
    """Newest rows of a cell, of every URL or one."""
    rows = cell if url is None else cell.filter(F.col(col) == url)
    return rows.orderBy(F.col(ts).desc(), "device_id").limit(limit)


def response_chart(network: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Mean response per minute, 0 where empty."""
    value = F.round(F.avg("intervaltime"), 0).cast("long").alias("response")
    return _series(network, "log_tm", tg.MINUTE, [value], start_ms, end_ms, {"response": 0})


def percentiles_rank(network: DataFrame, now_ms: int, hours: int, value: int, url: str | None = None) -> DataFrame:
    """5th and 95th percentile of response over the last hours per URL, and the share of rows up to a value."""
    rows = between_ms(network, "log_tm", now_ms - hours * tg.HOUR, now_ms + 1).filter("intervaltime >= 0")
    rows = rows.withColumn("url", F.col("req_url"))
    if url is not None:
        rows = rows.filter(F.col("url") == url)
    bounds = percentiles(rows, ["url"], "intervaltime", {"top": 0.05, "bottom": 0.95})
    rank = rows.groupBy("url").agg(F.round(F.avg(F.when(F.col("intervaltime") <= value, 100.0).otherwise(0.0)), 6).alias("rank"))
    return bounds.join(rank, "url").withColumnRenamed("n", "cnt")


def value_histogram(df: DataFrame, metric: str, width: int, low: int | None = None, high: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty buckets of a fixed width between two bounds."""
    rows = df.filter(F.col(metric) >= (0 if low is None else low))
    if high is not None:
        rows = rows.filter(F.col(metric) <= high)
    bucket = (F.floor(F.col(metric) / width) * width).cast("long").alias("bucket")
    return rows.groupBy(*by, bucket).agg(count_rows())


def median_times(pages: DataFrame, by: str, day: dt.date, days: int = 3) -> DataFrame:
    """Median loading and response of the last days by URL or model."""
    rows = pages.filter(tg.in_days("log_date", day - dt.timedelta(days=days), day))
    loading = medians(rows, [by], "loading_time", "med_loading")
    response = medians(rows.filter("request_count > 0"), [by], "response_time", "med_response")
    return loading.join(response, by, "full")


def model_ratio(pages: DataFrame, network: DataFrame, os_type: str | None = None) -> DataFrame:
    """Median loading and mean response by OS and model."""
    if os_type is not None:
        pages, network = (d.filter(F.col("os_type") == os_type) for d in (pages, network))
    by = ["os_type", "device_model"]
    response = network.groupBy(*by).agg(mean("intervaltime", "avg_response"), count_rows("calls"))
    return medians(pages, by, "loading_time", "med_loading").join(response, by, "full")


def usage_by_model(df: DataFrame, metric: str, n: int = 7) -> DataFrame:
    """Models with the largest mean, and the largest, smallest and mean of those means."""
    top = (
        df.filter(F.col(metric).isNotNull()).groupBy("device_model").agg(F.round(F.avg(metric), 6).alias("usage"), F.max("os_type").alias("os_type"))
        .orderBy(F.col("usage").desc(), "device_model").limit(n)
    )
    means = {"max_usage": F.max("usage"), "min_usage": F.min("usage"), "avg_usage": F.round(F.avg("usage"), 6)}
    return with_overall(top, top, means)


def metric_stats(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and mean non-zero value of each metric."""
    aggs = []
    for metric in metrics:
        value = F.nullif(F.col(metric), F.lit(0))
        aggs += [F.min(value).alias(f"min_{metric}"), F.max(value).alias(f"max_{metric}"), F.round(F.avg(value), 6).alias(f"avg_{metric}")]
    return df.groupBy(*by).agg(*aggs)


def daily_percentile(df: DataFrame, metric: str, p: float, tz: str = "UTC", ts: str = "page_start_tm") -> DataFrame:
    """Per day and OS: largest, median, smallest value and a percentile, then count and mean of the rows from it up."""
    by = ["day", "os_type"]
    rows = df.filter(F.col(metric).isNotNull()).withColumn("day", tg.day_of(ts, tz))
    # Everything is read from counts of equal values, so the rows themselves are never joined.
    value = F.col(metric)
    counts = rows.groupBy(*by, metric).agg(count_rows("_n"))
    points = percentiles(counts, by, metric, {"med_value": 0.5, "p_value": p}, weight="_n").drop("n")
    above = F.when(value >= F.col("p_value"), F.col("_n"))
    return counts.join(points, by).groupBy(*by, "med_value", "p_value").agg(
        F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.sum(above).alias("tail_count"),
        F.round(F.sum(above * value) / F.sum(above), 6).alias("tail_avg"),
    )


def top20_models(df: DataFrame, metric: str, n: int = 20) -> DataFrame:
    """Models with the largest single value, with devices, OS and median."""
    top = (
        df.filter(F.col(metric).isNotNull()).groupBy("device_model")
        .agg(F.max(metric).alias("max_value"), F.count_distinct("device_id").alias("devices"), F.max("os_type").alias("os_type"))
        .orderBy(F.col("max_value").desc(), "device_model").limit(n)
    )
    rows = df.join(top.select("device_model"), "device_model", "left_semi")
    return top.join(medians(rows, ["device_model"], metric, "med_value"), "device_model")


RATINGS = ("good", "needs-improvement", "poor")


def vital_rating(vitals: DataFrame, name: str | None = None) -> DataFrame:
    """Whole-percent share of each rating per vital; the three need not add up to 100."""
    rows = vitals if name is None else vitals.filter(F.col("name") == name)
    return rows.groupBy("name").agg(
        *[(F.count_if(F.col("rating") == r) * 100.0 / F.count(F.lit(1))).cast("int").cast("long").alias(r.replace("-", "_")) for r in RATINGS]
    )


def vital_trend(vitals: DataFrame, start_ms: int, end_ms: int, name: str | None = None) -> DataFrame:
    """Mean value per 5 minutes of each vital, 0 where empty."""
    rows = vitals if name is None else vitals.filter(F.col("name") == name)
    return _series(rows, "log_tm", 5 * tg.MINUTE, [mean("value", "avg_value", None)], start_ms, end_ms, {"avg_value": 0.0}, ["name"])


def vital_means(vitals: DataFrame, names: Sequence[str] = ("lcp", "inp", "cls", "fcp")) -> DataFrame:
    """Mean of each vital in one row, 0 when there is none."""
    return vitals.agg(
        *[F.coalesce(F.round(F.avg(F.when(F.col("name") == n, F.col("value"))), 6), F.lit(0.0)).alias(n) for n in names]
    )


def vitals_by_page(pages: DataFrame) -> DataFrame:
    """Mean vitals and loading of web pages; NULL stands for a blank."""
    return pages.filter(F.col("log_type") == lt.WEB_START).groupBy("page_name").agg(
        *[mean(c, c, 6) for c in ("lcp", "inp", "cls", "fcp")],
        F.coalesce(F.round(F.avg("loading_time"), 6), F.lit(0.0)).alias("loading_avg"), count_rows(),
    )


def latest_vitals(vitals: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Last value of each vital of a page view."""
    if views is not None:
        vitals = vitals.join(views.select("page_id").distinct(), "page_id", "left_semi")
    return vitals.groupBy("page_id", "name").agg(F.max_by("value", F.struct("log_tm", "value")).alias("value"))


ERROR_GROUPS = ("3xx", "4xx", "5xx")


def api_errors(network: DataFrame) -> DataFrame:
    """Failing calls by URL and status with their share of all failing calls."""
    failed = network.filter(F.col("status_group").isin(*ERROR_GROUPS))
    counts = failed.groupBy("req_url", "status_code").agg(count_rows())
    return with_total(counts, "cnt", "_all").select(
        "req_url", "status_code", "cnt", F.round(F.col("cnt") * 100.0 / F.col("_all"), 6).alias("ratio")
    )


def api_error_chart(network: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Failing calls per 5 minutes of each status group, every step present."""
    failed = network.filter(F.col("status_group").isin(*ERROR_GROUPS))
    return _series(failed, "log_tm", 5 * tg.MINUTE, [count_rows()], start_ms, end_ms, {"cnt": 0}, ["status_group"])


def api_error_rows(network: DataFrame, url: str, status: int, limit: int) -> DataFrame:
    """Newest failing calls of a URL and status."""
    rows = network.filter((F.col("req_url") == url) & (F.col("status_code") == status) & F.col("status_group").isin(*ERROR_GROUPS))
    return rows.orderBy(F.col("log_tm").desc(), "device_id").limit(limit)


def _aggregate(rows: DataFrame, key: str, aggs: Sequence[Column], size: int | None, contains: str | None, marked: Sequence[str] | None, after: str | None) -> DataFrame:
    if contains:
        rows = rows.filter(F.col(key).contains(contains))
    if marked:
        rows = rows.filter(F.col(key).isin(*marked))
    if after is not None:
        rows = rows.filter(F.col(key) > after)
    grouped = rows.groupBy(key).agg(*aggs)
    return grouped if size is None else grouped.orderBy(key).limit(size)


def page_aggregate(pages: DataFrame, size: int | None = None, contains: str | None = None, marked: Sequence[str] | None = None, after: str | None = None, url: str = "page_name") -> DataFrame:
    """Per web page mean positive vitals, mean loading and devices, in URL order after a key."""
    aggs = [mean_positive(c, f"{c}_avg", 6) for c in ("lcp", "inp", "cls")]
    aggs += [mean("loading_time", "loading_time"), F.count_distinct("device_id").alias("users")]
    return _aggregate(pages.filter(F.col("log_type").isin(*lt.WEB_PAGE)), url, aggs, size, contains, marked, after)


def network_aggregate(network: DataFrame, size: int | None = None, contains: str | None = None, marked: Sequence[str] | None = None, after: str | None = None, url: str = "req_url") -> DataFrame:
    """Per URL mean response, calls by status group and devices."""
    aggs = [mean("intervaltime", "response_time")]
    aggs += [F.count_if(F.col("status_group") == g).alias(f"s{g}") for g in ("2xx", "4xx", "5xx")]
    aggs.append(F.count_distinct("device_id").alias("users"))
    return _aggregate(network, url, aggs, size, contains, marked, after)


def error_aggregate(trouble: DataFrame, size: int | None = None, contains: str | None = None, marked: Sequence[str] | None = None, after: str | None = None, message: str = "log_name") -> DataFrame:
    """Per message rows and devices."""
    rows = trouble.filter(F.col("log_type").isin(*lt.FRONT_ERROR))
    return _aggregate(rows, message, [count_rows(), F.count_distinct("device_id").alias("users")], size, contains, marked, after)


def dimension_ratio(pages: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Web page rows, their share and mean positive vitals by browser, version, platform or OS."""
    rows = pages.filter(F.col("log_type").isin(*lt.WEB_PAGE))
    grouped = rows.groupBy(*dims).agg(count_rows(), *[mean_positive(c, f"{c}_avg", 6) for c in ("lcp", "inp", "cls")])
    return with_total(grouped, "cnt", "_all").withColumn("rate", F.round(F.col("cnt") * 100.0 / F.col("_all"), 4)).drop("_all")


def half_hour_series(df: DataFrame, ts: str, start: dt.date, end: dt.date, users: bool = False) -> DataFrame:
    """Rows, or distinct devices, per half hour over whole days."""
    value = (F.count_distinct("device_id") if users else F.count(F.lit(1))).alias("cnt")
    return _series(df, ts, 30 * tg.MINUTE, [value], tg.millis(start), tg.millis(end) + tg.DAY, {"cnt": 0})


def ten_min_series(df: DataFrame, ts: str, metric: str, start_ms: int, end_ms: int) -> DataFrame:
    """Mean per 10 minutes, with the mean and count of all rows on each."""
    rows = between_ms(df, ts, start_ms, end_ms)
    series = _series(rows, ts, 10 * tg.MINUTE, [mean(metric, "avg_value"), count_rows()], start_ms, end_ms, {"avg_value": 0.0, "cnt": 0})
    return with_overall(series, rows, {"total_avg": F.round(F.avg(metric), 6), "total": F.count(F.lit(1))})


def list_with_mean(df: DataFrame, ts: str, metric: str, size: int, cond: Column | None = None) -> DataFrame:
    """Newest rows, with the mean over every matching row."""
    rows = df if cond is None else df.filter(cond)
    newest = rows.orderBy(F.col(ts).desc(), "device_id").limit(size)
    return with_overall(newest, rows, {"mean_value": F.round(F.avg(metric), 6)})


def speed_classes(rows: DataFrame, standards: DataFrame, time: str, key: str = "page_name") -> DataFrame:
    """Class 0 to 4 of each row against the standard of its URL, 4 where there is none."""
    named = standards.groupBy(F.col("url").alias(key)).agg(F.max("standard_ms").alias("_standard"))
    joined = rows.join(named, key, "left")
    return joined.withColumn("speed_class", text.speed_class(time, "_standard")).drop("_standard")


def over_limit(df: DataFrame, metric: str, limit: int, day: dt.date) -> DataFrame:
    """The day's rows above a threshold."""
    return on_day(df, day).filter(F.col(metric) > limit)


def viewer_chart(pages: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Distinct viewers per bucket; the bucket grows with the range."""
    width = tg.adaptive_width(start_ms, end_ms)
    return _series(pages, "page_start_tm", width, [F.count_distinct("device_id").alias("viewers"), count_rows("views")], start_ms, end_ms, {"viewers": 0, "views": 0})
