"""Rollups, their merges, and the counters read from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import kpi, rollup
from tidemark.operators.common import DIMS
from tidemark.plans.registry import VISITS, Tables, query
from tidemark.sources import driver_tables as dtb

_MEASURES = """
CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(response_time) AS BIGINT) AS response_time,
CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(sum_mem_usage) AS BIGINT) AS sum_mem_usage,
CAST(sum(sum_cpu_usage) AS BIGINT) AS sum_cpu_usage, CAST(sum(error_count) AS BIGINT) AS error_count,
CAST(sum(js_error_count) AS BIGINT) AS js_error_count, CAST(sum(crash_count) AS BIGINT) AS crash_count,
CAST(sum(log_count) AS BIGINT) AS log_count, CAST(coalesce(sum(intervaltime), 0) AS BIGINT) AS sum_intervaltime,
count(intervaltime) AS n_intervaltime, CAST(coalesce(sum(loading_time), 0) AS BIGINT) AS sum_loading_time,
count(loading_time) AS n_loading_time, count(*) AS cnt, count(DISTINCT device_id) AS device_count
"""


@query(
    "page_daily",
    f"SELECT CAST(log_date AS VARCHAR) AS log_date, package_nm, server_type, os_type, page_name, {_MEASURES} FROM page_flow GROUP BY ALL",
)
def _(t: Tables):
    return t.page_daily


@query(
    "model_hourly",
    f"SELECT CAST(date_trunc('hour', page_start_tm_dt) AS VARCHAR) AS hour_bucket, package_nm, server_type, os_type, device_model, {_MEASURES} FROM page_flow GROUP BY ALL",
)
def _(t: Tables):
    return t.model_hourly


@query(
    "model_daily",
    f"SELECT CAST(log_date AS VARCHAR) AS log_date, package_nm, server_type, os_type, device_model, {_MEASURES} FROM page_flow GROUP BY ALL",
)
def _(t: Tables):
    return rollup.model_daily(t.pages)


@query(
    "merge_rollup",
    f"""
    SELECT page_name, {_MEASURES}, sum(intervaltime) / count(intervaltime) AS avg_intervaltime,
           sum(loading_time) / count(loading_time) AS avg_loading_time FROM page_flow GROUP BY page_name
    """,
)
def _(t: Tables):
    return rollup.merge_rollup(t.page_daily, ["page_name"], rollup.rollup_devices(t.pages, ["log_date", "page_name"]))


@query("merge_rollup_sketch", None)
def _(t: Tables):
    """Approximate distinct devices from mergeable sketches; no exact SQL exists for an estimate."""
    return rollup.merge_rollup(rollup.page_daily(t.pages, sketch=True), ["page_name"]).select("page_name", "cnt", "device_count")


@query(
    "access_history",
    """
    SELECT CAST(log_date AS VARCHAR) AS log_date, package_nm, server_type, os_type, device_id, visit_cnt, install_cnt,
           CAST(login_cnt AS BIGINT) AS login_cnt FROM access_history
    """,
)
def _(t: Tables):
    return t.access


def _bitmaps(t: Tables):
    numbers = rollup.number_devices(t.events, slots=64)
    return rollup.access_bitmap(t.events, numbers, VISITS)


@query(
    "access_bitmap",
    """
    SELECT CAST(log_date AS VARCHAR) AS log_date, package_nm, server_type, os_type, count(DISTINCT device_id) AS device_count
    FROM access_history GROUP BY ALL
    """,
)
def _(t: Tables):
    return rollup.bitmap_cardinality(_bitmaps(t), ["log_date", *DIMS])


_DAY_USERS = f"""
users AS (
  SELECT package_nm, server_type, os_type, count(*) FILTER (d) AS dau, count(*) FILTER (d AND w) AS revisit_7d, count(*) AS mau
  FROM (SELECT package_nm, server_type, os_type, device_id, bool_or(log_date = DATE '{dtb.AS_OF}') AS d,
          bool_or(log_date >= DATE '{dtb.AS_OF}' - 7 AND log_date < DATE '{dtb.AS_OF}') AS w
        FROM access_history WHERE log_date >= DATE '{dtb.AS_OF}' - 30 GROUP BY ALL) GROUP BY ALL HAVING count(*) FILTER (d) > 0),
visits AS (
  SELECT package_nm, server_type, os_type, CAST(sum(visit_cnt) AS BIGINT) AS visit, CAST(sum(install_cnt) AS BIGINT) AS install,
         CAST(sum(login_cnt) AS BIGINT) AS login FROM access_history WHERE log_date = DATE '{dtb.AS_OF}' GROUP BY ALL),
page AS (
  SELECT package_nm, server_type, os_type, CAST(sum(crash_count) AS BIGINT) AS crash_count, CAST(sum(error_count) AS BIGINT) AS error_count,
         CAST(sum(js_error_count) AS BIGINT) AS js_error_count, CAST(sum(log_count) AS BIGINT) AS log_count,
         round(avg(intervaltime), 6) AS intervaltime_avg, round(avg(lcp), 6) AS lcp_avg, round(avg(ttfb), 6) AS ttfb_avg,
         round(avg(fcp), 6) AS fcp_avg, round(avg(inp), 6) AS inp_avg, count(*) AS pv
  FROM page_flow WHERE log_date = DATE '{dtb.AS_OF}' GROUP BY ALL)
"""


@query("active_users", "SELECT * FROM users", ctes=_DAY_USERS)
def _(t: Tables):
    return kpi.active_users(t.access, dtb.AS_OF)


@query("active_users_bitmap", "SELECT * FROM users", ctes=_DAY_USERS)
def _(t: Tables):
    return kpi.active_users_bitmap(_bitmaps(t), dtb.AS_OF)


@query("visit_totals", "SELECT * FROM visits", ctes=_DAY_USERS)
def _(t: Tables):
    return kpi.visit_totals(t.access, dtb.AS_OF)


@query("page_kpis", "SELECT * FROM page", ctes=_DAY_USERS)
def _(t: Tables):
    return kpi.page_kpis(t.pages, dtb.AS_OF)


_MERGED = """
SELECT {day} package_nm, server_type, os_type, coalesce(visit, 0) AS visit, coalesce(install, 0) AS install, coalesce(login, 0) AS login,
       coalesce(dau, 0) AS dau, coalesce(revisit_7d, 0) AS revisit_7d, coalesce(mau, 0) AS mau, coalesce(crash_count, 0) AS crash_count,
       coalesce(error_count, 0) AS error_count, coalesce(js_error_count, 0) AS js_error_count, coalesce(log_count, 0) AS log_count,
       coalesce(intervaltime_avg, 0) AS intervaltime_avg, coalesce(lcp_avg, 0) AS lcp_avg, coalesce(ttfb_avg, 0) AS ttfb_avg,
       coalesce(fcp_avg, 0) AS fcp_avg, coalesce(inp_avg, 0) AS inp_avg, coalesce(pv, 0) AS pv
FROM users FULL JOIN visits USING (package_nm, server_type, os_type) FULL JOIN page USING (package_nm, server_type, os_type)
"""


@query("merge_kpis", _MERGED.format(day=""), ctes=_DAY_USERS)
def _(t: Tables):
    return kpi.merge_kpis(
        kpi.visit_totals(t.access, dtb.AS_OF), kpi.active_users(t.access, dtb.AS_OF), kpi.page_kpis(t.pages, dtb.AS_OF)
    )


@query("daily_statistic", _MERGED.format(day=f"'{dtb.AS_OF}' AS stat_date,"), ctes=_DAY_USERS)
def _(t: Tables):
    day = dtb.AS_OF
    return rollup.daily_statistic(
        kpi.visit_totals(t.access, day), kpi.active_users(t.access, day), kpi.page_kpis(t.pages, day), day
    )


_COUNTS = """
CAST(sum(crash_count) AS BIGINT) AS crash_count, CAST(sum(error_count) AS BIGINT) AS error_count,
CAST(sum(js_error_count) AS BIGINT) AS js_error_count, CAST(sum(log_count) AS BIGINT) AS log_count,
CAST(coalesce(sum(intervaltime), 0) AS BIGINT) AS sum_intervaltime, count(intervaltime) AS n_intervaltime, count(*) AS cnt
"""


@query(
    "page_log_counts",
    f"SELECT package_nm, server_type, os_type, {_COUNTS} FROM page_flow WHERE log_date = DATE '{dtb.AS_OF}' GROUP BY ALL",
)
def _(t: Tables):
    return rollup.page_log_counts(t.page_daily, dtb.AS_OF, dtb.AS_OF)


@query(
    "page_log_counts_month",
    f"SELECT CAST(log_date AS VARCHAR) AS log_date, package_nm, server_type, os_type, {_COUNTS} FROM page_flow WHERE log_date >= DATE '{dtb.AS_OF}' - 31 GROUP BY ALL",
)
def _(t: Tables):
    return rollup.page_log_counts(t.page_daily, dtb.AS_OF - dt.timedelta(days=31), dtb.AS_OF, by_day=True)


@query(
    "response_histogram",
    """
    SELECT package_nm, server_type, split_part(req_url, '?', 1) AS url_path, intervaltime // 100 * 100 AS bucket, count(*) AS cnt,
           quantile_cont(intervaltime, 0.25) AS q1, quantile_cont(intervaltime, 0.5) AS median, quantile_cont(intervaltime, 0.75) AS q3
    FROM network_log GROUP BY ALL
    """,
)
def _(t: Tables):
    return rollup.response_histogram(t.network)


@query(
    "response_histogram_by_model",
    """
    SELECT package_nm, server_type, split_part(req_url, '?', 1) AS url_path, device_model, intervaltime // 500 * 500 AS bucket, count(*) AS cnt,
           quantile_cont(intervaltime, 0.25) AS q1, quantile_cont(intervaltime, 0.5) AS median, quantile_cont(intervaltime, 0.75) AS q3
    FROM network_log GROUP BY ALL
    """,
)
def _(t: Tables):
    return rollup.response_histogram(t.network, step=500, slice_by="device_model")


@query(
    "number_devices",
    "SELECT count(*) AS devices, count(*) AS numbers, true AS compact FROM (SELECT DISTINCT device_id FROM event_log)",
)
def _(t: Tables):
    early = t.events.filter(F.col("log_date") < F.lit(dt.date(2024, 1, 3)))
    numbers = rollup.number_devices(t.events, rollup.number_devices(early, slots=16), slots=16)
    return numbers.agg(
        F.count(F.lit(1)).alias("devices"), F.count_distinct("device_no").alias("numbers"),
        (F.max("device_no") < 4 * F.count(F.lit(1)) + 64).alias("compact"),
    )
