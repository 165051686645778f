"""Mergeable sketches, stored by hour or day and merged for any range: quantiles, sets with intersections, heavy hitters.

They are options beside the exact operators, for ranges whose rows are too many to read again. Each says how far it may be off.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timegrid as tg
from tidemark.operators.common import DIMS, count_rows

QUANTILE_K = 400  # rank error of about 0.7%
SET_LG = 14  # sets of up to 2^14 devices are exact; beyond that the error is about 1 / sqrt(2^14), of the union for an intersection
TRACKED = 10_000  # items that a heavy-hitter state may hold


def hourly_quantiles(rows: DataFrame, by: Sequence[str], value: str, ts: str = "page_start_tm", tz: str = "UTC", k: int = QUANTILE_K) -> DataFrame:
    """Rows (hour_bucket, by, quantiles, n): a sketch of the non-NULL values of each hour and group, of whole numbers or of doubles.

    Sketches are made in each task before rows move, so a hot group costs one small sketch a task. Groups without a value have no row.
    """
    make = F.kll_sketch_agg_double if rows.schema[value].dataType.simpleString() in ("double", "float") else F.kll_sketch_agg_bigint
    given = rows.filter(F.col(value).isNotNull()).withColumn("hour_bucket", tg.hour_of(ts, tz))
    return given.groupBy("hour_bucket", *by).agg(make(value, k).alias("quantiles"), count_rows("n"))


def range_quantiles(stored: DataFrame, by: Sequence[str], points: Mapping[str, float], doubles: bool = False) -> DataFrame:
    """Quantiles over all stored rows of each group, and ``n``; filter the hours before. Ranks are off by about 0.7% of the group at the default size."""
    merge, read = (
        (F.kll_merge_agg_double, F.kll_sketch_get_quantile_double) if doubles else (F.kll_merge_agg_bigint, F.kll_sketch_get_quantile_bigint)
    )
    merged = stored.groupBy(*by).agg(merge("quantiles").alias("_merged"), F.sum("n").alias("n"))
    return merged.select(*by, "n", *[read("_merged", F.lit(float(p))).alias(name) for name, p in points.items()])


def daily_devices(access: DataFrame, lg: int = SET_LG) -> DataFrame:
    """Rows (log_date, app, devices): a set sketch of each day's devices."""
    return access.groupBy("log_date", *DIMS).agg(F.theta_sketch_agg("device_id", lg).alias("devices"))


def _union(cond: Column, lg: int) -> Column:
    return F.theta_union_agg(F.when(cond, F.col("devices")), lg)


def _size(sketch: Column | str) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def active_users_sketch(stored: DataFrame, day: dt.date, lg: int = SET_LG) -> DataFrame:
    """DAU, 7-day revisits and MAU (31 dates) from stored days, in the shape of ``kpi.active_users``.

    Revisits are the intersection of the day's set with the week's union; sets of hash values intersect, counts of registers do not.
    Exact up to 2^lg devices a month and app.
    """
    date = F.col("log_date")
    rows = stored.filter(date.between(F.lit(day - dt.timedelta(days=30)), F.lit(day)))
    today, week = date == F.lit(day), (date >= F.lit(day - dt.timedelta(days=7))) & (date < F.lit(day))
    sets = rows.groupBy(*DIMS).agg(_union(today, lg).alias("d"), _union(week, lg).alias("w"), F.theta_union_agg("devices", lg).alias("m"), F.bool_or(today).alias("seen"))
    return sets.filter("seen").select(
        *DIMS, _size("d").alias("dau"), _size(F.theta_intersection("d", "w")).alias("revisit_7d"), _size("m").alias("mau"),
    )


def range_users_sketch(stored: DataFrame, start: dt.date, end: dt.date, lg: int = SET_LG) -> DataFrame:
    """Distinct devices of each app in any range of days, and how many of them were there in the range of the same length before."""
    before = start - (end - start) - dt.timedelta(days=1)
    date = F.col("log_date")
    rows = stored.filter(date.between(F.lit(before), F.lit(end)))
    sets = rows.groupBy(*DIMS).agg(_union(date >= F.lit(start), lg).alias("now"), _union(date < F.lit(start), lg).alias("then"), F.bool_or(date >= F.lit(start)).alias("seen"))
    return sets.filter("seen").select(*DIMS, _size("now").alias("users"), _size(F.theta_intersection("now", "then")).alias("returned"))


def hourly_hitters(rows: DataFrame, item: str, by: Sequence[str] = (), ts: str = "log_tm", tz: str = "UTC", tracked: int = TRACKED) -> DataFrame:
    """Rows (hour_bucket, by, hitters, n): a bounded state of the most frequent items of each hour and group; NULL items are left out."""
    given = rows.filter(F.col(item).isNotNull()).withColumn("hour_bucket", tg.hour_of(ts, tz)).withColumn("_item", F.col(item))
    return given.groupBy("hour_bucket", *by).agg(F.expr(f"approx_top_k_accumulate(_item, {int(tracked)})").alias("hitters"), count_rows("n"))


def range_hitters(stored: DataFrame, item: str, by: Sequence[str] = (), n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The ``n`` most frequent items over all stored rows of each group: (by, item, cnt, share, rank).

    While a state holds all items the counts are exact. Beyond that a count is off by at most 3.5 / ``tracked`` of the group's
    rows, and an item that is more frequent than that is always in the list.
    """
    keys = list(by) or ["_all"]
    given = stored if by else stored.withColumn("_all", F.lit(0))
    merged = given.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(hitters, {int(tracked)})").alias("_state"), F.sum("n").alias("_n"))
    # One more than asked for would not settle ties; equal counts go by item, among those the state gives.
    found = merged.select(*keys, "_n", F.explode(F.expr(f"approx_top_k_estimate(_state, {min(4 * int(n), int(tracked))})")).alias("_hit"))
    listed = found.groupBy(*keys, "_n").agg(F.sort_array(F.collect_list(F.struct((-F.col("_hit.count")).alias("c"), F.col("_hit.item").alias("i")))).alias("_hits"))
    ranked = listed.select(*keys, "_n", F.posexplode(F.slice("_hits", 1, n)).alias("_at", "_hit"))
    return ranked.select(*by, F.col("_hit.i").alias(item), (-F.col("_hit.c")).alias("cnt"), F.round(-F.col("_hit.c") * 100.0 / F.col("_n"), 4).alias("share"), (F.col("_at") + 1).alias("rank"))
