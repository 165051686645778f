"""Rollup tables that can be merged again: sums with counts, distinct devices, bitmaps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.segmented import percentiles
from tidemark.operators.common import DIMS, count_rows, sums

SUMMED = ("event_count", "response_time", "request_count", "sum_mem_usage", "sum_cpu_usage",
          "error_count", "js_error_count", "crash_count", "log_count")
AVERAGED = ("intervaltime", "loading_time")


def _clean(pages: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Dimensions without NULL: text becomes '', server type 0."""
    for name in ("package_nm", "os_type", *extra):
        pages = pages.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    return pages.withColumn("server_type", F.coalesce(F.col("server_type"), F.lit(0)).cast("long"))


def _parts() -> list[Column]:
    averaged = []
    for name in AVERAGED:
        averaged += [
            F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(f"sum_{name}"),
            F.count(name).alias(f"n_{name}"),
        ]
    return [*sums(*SUMMED), *averaged, count_rows()]


def _rollup(pages: DataFrame, by: list[str], sketch: bool) -> DataFrame:
    devices = [F.count_distinct("device_id").alias("device_count")]
    if sketch:
        devices = [F.hll_sketch_agg("device_id").alias("device_sketch")]
    return pages.groupBy(*by).agg(*_parts(), *devices)


def page_daily(pages: DataFrame, sketch: bool = False) -> DataFrame:
    """By day, app and page. ``device_count`` is exact for the row; ``sketch`` stores a mergeable one instead."""
    return _rollup(_clean(pages, ["page_name"]), ["log_date", *DIMS, "page_name"], sketch)


def model_hourly(pages: DataFrame, sketch: bool = False, tz: str = "UTC") -> DataFrame:
    """By hour, app and device model."""
    hourly = _clean(pages, ["device_model"]).withColumn("hour_bucket", tg.hour_of("page_start_tm", tz))
    return _rollup(hourly, ["hour_bucket", *DIMS, "device_model"], sketch)


def model_daily(pages: DataFrame, sketch: bool = False) -> DataFrame:
    """By day, app and device model."""
    return _rollup(_clean(pages, ["device_model"]), ["log_date", *DIMS, "device_model"], sketch)


def rollup_devices(pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """The distinct devices behind a rollup, one row each.

    Kept beside the sums table so that distinct counts stay exact after any merge. It replaces a set
    column, whose size would grow with a group's devices.
    """
    extra = [c for c in by if c in ("page_name", "device_model")]
    return _clean(pages, extra).select(*by, "device_id").distinct()


def signed_rollup(changes: DataFrame, by: Sequence[str], sign: str) -> DataFrame:
    """Mergeable parts of signed rows, +1 for a row that came and -1 for one that went; groups left as they were give no row."""
    rows = _clean(changes, [c for c in by if c in ("page_name", "device_model")])
    signed = [F.coalesce(F.sum(F.col(c) * F.col(sign)), F.lit(0)).cast("long").alias(c) for c in SUMMED]
    for name in AVERAGED:
        signed += [
            F.coalesce(F.sum(F.col(name) * F.col(sign)), F.lit(0)).cast("long").alias(f"sum_{name}"),
            F.coalesce(F.sum(F.when(F.col(name).isNotNull(), F.col(sign))), F.lit(0)).cast("long").alias(f"n_{name}"),
        ]
    parts = rows.groupBy(*by).agg(*signed, F.sum(sign).cast("long").alias("cnt"))
    measures = [c for c in parts.columns if c not in by]
    return parts.filter(F.greatest(*[F.abs(c) for c in measures]) > 0)


def signed_devices(changes: DataFrame, by: Sequence[str], sign: str) -> DataFrame:
    """How many rows of each group and device came or went; a device is in a group while the sum over all changes is positive."""
    rows = _clean(changes, [c for c in by if c in ("page_name", "device_model")])
    return rows.groupBy(*by, "device_id").agg(F.sum(sign).cast("long").alias("n")).filter("n <> 0")


def merge_rollup(rollup: DataFrame, by: Sequence[str], devices: DataFrame | None = None) -> DataFrame:
    """Merge stored rows: sums of sums, sum / count averages, devices counted from their own table.

    Without ``devices`` a ``device_sketch`` column, if present, gives an approximate count.
    """
    by = list(by)
    parts = [c for c in rollup.columns if c.startswith("n_") or c in SUMMED or c == "cnt" or c.startswith("sum_")]
    aggs = sums(*dict.fromkeys(parts))
    if devices is None and "device_sketch" in rollup.columns:
        aggs.append(F.hll_sketch_estimate(F.hll_union_agg("device_sketch")).alias("device_count"))
    merged = rollup.groupBy(*by).agg(*aggs)
    for name in AVERAGED:
        merged = merged.withColumn(f"avg_{name}", F.col(f"sum_{name}") / F.nullif(F.col(f"n_{name}"), F.lit(0)))
    if devices is None:
        return merged
    counted = devices.groupBy(*by).agg(F.count_distinct("device_id").alias("device_count"))
    return merged.join(counted, by, "left").fillna(0, ["device_count"])


def access_history(pages: DataFrame, types: Sequence[int] = lt.INSTALL_OR_START) -> DataFrame:
    """Visits and installs by day, app and device. Logins come from elsewhere and are 0 here."""
    return (
        pages.filter(F.col("log_type").isin(*types))
        .groupBy("log_date", *DIMS, "device_id")
        .agg(
            count_rows("visit_cnt"),
            F.count_if(F.col("log_type") == lt.APP_FIRST_START).alias("install_cnt"),
        )
        .withColumn("login_cnt", F.lit(0).cast("long"))
    )


def number_devices(devices: DataFrame, known: DataFrame | None = None, slots: int = 4096) -> DataFrame:
    """Give every device a small unique number, continuing a stored numbering.

    Devices are dealt into ``slots`` by hash and numbered inside their slot, so there is no global order
    to compute and the numbers stay nearly dense, which keeps bitmaps small.
    """
    slot = F.pmod(F.xxhash64("device_id"), F.lit(slots))
    fresh = devices.select("device_id").distinct()
    if known is not None:
        fresh = fresh.join(known, "device_id", "left_anti")
    fresh = fresh.withColumn("_slot", slot)
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("device_id")).cast("long")
    if known is None:
        return fresh.select("device_id", ((rank - 1) * slots + F.col("_slot")).alias("device_no"))
    used = known.groupBy(F.pmod(F.col("device_no"), F.lit(slots)).alias("_slot")).agg(
        (F.max("device_no") - F.pmod(F.max("device_no"), F.lit(slots))).alias("_base")
    )
    ranked = fresh.withColumn("_rank", rank).join(used, "_slot", "left")
    base = F.coalesce(F.col("_base") + slots, F.lit(0).cast("long"))
    added = ranked.select("device_id", (base + (F.col("_rank") - 1) * slots + F.col("_slot")).alias("device_no"))
    return known.select("device_id", "device_no").unionByName(added)


def access_bitmap(
    pages: DataFrame, numbers: DataFrame, types: Sequence[int] = lt.INSTALL_OR_START
) -> DataFrame:
    """Distinct devices by day and app as bitmaps, one 4 KB row per block of 32,768 device numbers."""
    seen = pages.filter(F.col("log_type").isin(*types)).select("log_date", *DIMS, "device_id").distinct()
    numbered = seen.join(numbers, "device_id")
    return (
        numbered.groupBy("log_date", *DIMS, F.bitmap_bucket_number("device_no").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("device_no")).alias("users"))
    )


def bitmap_cardinality(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct devices over any grouping of bitmap rows."""
    merged = bitmaps.groupBy(*by, "block").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("users")).alias("device_count"))


STATISTIC_DEFAULTS: Mapping[str, object] = {
    **dict.fromkeys(("visit", "install", "login", "dau", "revisit_7d", "mau", "crash_count", "error_count",
                     "js_error_count", "log_count", "pv"), 0),
    **dict.fromkeys(("intervaltime_avg", "lcp_avg", "ttfb_avg", "fcp_avg", "inp_avg"), 0.0),
}


def _keyed(df: DataFrame) -> DataFrame:
    """Rows that name package, server and OS; others are skipped."""
    return df.filter(
        (F.coalesce("package_nm", F.lit("")) != "")
        & F.col("server_type").isNotNull()
        & (F.coalesce("os_type", F.lit("")) != "")
    )


def merge_on_dims(*frames: DataFrame) -> DataFrame:
    """Full outer merge of metric frames on package, server and OS, zero-filled."""
    merged = _keyed(frames[0])
    for frame in frames[1:]:
        merged = merged.join(_keyed(frame), DIMS, "full")
    return merged.select(
        *DIMS,
        *[
            F.coalesce(F.col(c), F.lit(STATISTIC_DEFAULTS.get(c, 0)).cast(merged.schema[c].dataType)).alias(c)
            for c in merged.columns
            if c not in DIMS
        ],
    )


def daily_statistic(visits: DataFrame, users: DataFrame, pages: DataFrame, day: dt.date) -> DataFrame:
    """The day's row per app from visit, user and page metrics."""
    return merge_on_dims(visits, users, pages).withColumn("stat_date", F.lit(day))


def page_log_counts(rollup: DataFrame, start: dt.date, end: dt.date, by_day: bool = False) -> DataFrame:
    """Crash, error, log, stay and row sums of a period from a daily rollup."""
    rows = rollup.filter(tg.in_days("log_date", start, end))
    by = ["log_date", *DIMS] if by_day else DIMS
    return rows.groupBy(*by).agg(
        *sums("crash_count", "error_count", "js_error_count", "log_count", "sum_intervaltime", "n_intervaltime", "cnt")
    )


def response_histogram(
    network: DataFrame, step: int = 100, url: str | None = None, slice_by: str | None = None
) -> DataFrame:
    """Row count and quartiles per response bucket and URL, optionally per model, carrier or network."""
    rows = network.withColumn("url_path", F.substring_index("req_url", "?", 1))
    if url is not None:
        rows = rows.filter(F.col("url_path") == url)
    by = ["package_nm", "server_type", "url_path", *([slice_by] if slice_by else []), "bucket"]
    bucketed = rows.withColumn("bucket", (F.floor(F.col("intervaltime") / step) * step).cast("long"))
    found = percentiles(bucketed, by, "intervaltime", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return found.withColumnRenamed("n", "cnt")
