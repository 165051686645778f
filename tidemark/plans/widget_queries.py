"""Dashboard widgets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import literal_frame
from tidemark.operators import rollup, widgets
from tidemark.plans.registry import VISITS, Tables, query
from tidemark.sources import driver_tables as dtb

_D = dtb.AS_OF
START, END = tg.millis(dt.date(2024, 1, 8)), tg.millis(dt.date(2024, 1, 22))


def hourly_devices(t: Tables):
    pages = t.pages.withColumn("hour_bucket", tg.hour_of("page_start_tm"))
    return rollup.rollup_devices(pages, ["hour_bucket", "package_nm", "server_type", "os_type", "device_model"])


def model_frames(t: Tables):
    return t.model_hourly, hourly_devices(t)


_MODELS = f"""
models AS (
  SELECT package_nm, server_type, os_type, device_model, CAST(sum(log_count) AS BIGINT) AS log_count, CAST(sum(error_count) AS BIGINT) AS error_count,
         CAST(sum(crash_count) AS BIGINT) AS crash_count, CAST(sum(sum_cpu_usage) AS BIGINT) AS sum_cpu_usage,
         CAST(sum(sum_mem_usage) AS BIGINT) AS sum_mem_usage, count(DISTINCT device_id) AS device_count
  FROM page_flow WHERE log_date = DATE '{_D}' GROUP BY 1, 2, 3, 4),
model_sums AS (
  SELECT package_nm, server_type, os_type, CAST(sum(device_count) AS BIGINT) AS total_devices, CAST(sum(log_count) AS BIGINT) AS total_views,
         CAST(sum(error_count) AS BIGINT) AS total_errors, CAST(sum(crash_count) AS BIGINT) AS total_crashes, count(*) AS models FROM models GROUP BY 1, 2, 3)
"""


@query(
    "device_distribution",
    """
    SELECT package_nm, server_type, os_type, device_model, device_count, log_count AS view_count, error_count, crash_count,
           CASE WHEN total_errors > 0 THEN round(error_count * 100.0 / total_errors, 2) ELSE 0.0 END AS error_rate,
           CASE WHEN total_crashes > 0 THEN round(crash_count * 100.0 / total_crashes, 2) ELSE 0.0 END AS crash_rate,
           total_devices, total_views, total_errors, total_crashes
    FROM models JOIN model_sums USING (package_nm, server_type, os_type)
    QUALIFY row_number() OVER (PARTITION BY package_nm, server_type, os_type ORDER BY log_count DESC, error_count DESC, crash_count DESC, device_model) <= 100
    """,
    ctes=_MODELS,
)
def _(t: Tables):
    return widgets.device_distribution(*model_frames(t), _D)


@query(
    "device_list",
    """
    SELECT package_nm, server_type, os_type, device_model, device_count, log_count, error_count, crash_count FROM models
    ORDER BY device_count DESC, device_model, package_nm, server_type, os_type LIMIT 11 OFFSET 10
    """,
    ctes=_MODELS,
)
def _(t: Tables):
    return widgets.device_list(*model_frames(t), _D, 10, 10)


@query(
    "device_totals",
    """
    SELECT package_nm, server_type, os_type, models, total_devices AS device_count, total_views AS log_count, total_errors AS error_count,
           total_crashes AS crash_count FROM model_sums
    """,
    ctes=_MODELS,
)
def _(t: Tables):
    return widgets.device_totals(*model_frames(t), _D)


@query(
    "device_series_hourly",
    f"""
    SELECT device_model, m AS hour_ms, coalesce(users, 0) AS users, coalesce(e, 0) AS error_count, coalesce(c, 0) AS crash_count
    FROM (SELECT * FROM (SELECT DISTINCT device_model FROM page_flow WHERE log_date = DATE '{_D}'),
          generate_series(epoch_ms(TIMESTAMP '{_D}'), epoch_ms(TIMESTAMP '{_D}') + 82800000, 3600000) g(m))
    LEFT JOIN (SELECT device_model, page_start_tm // 3600000 * 3600000 AS m, count(DISTINCT device_id) AS users, CAST(sum(error_count) AS BIGINT) AS e,
               CAST(sum(crash_count) AS BIGINT) AS c FROM page_flow WHERE log_date = DATE '{_D}' GROUP BY 1, 2) USING (device_model, m)
    """,
)
def _(t: Tables):
    return widgets.device_series(t.pages, _D, _D)


@query(
    "device_series_daily",
    f"""
    SELECT device_model, CAST(d AS VARCHAR) AS log_date, coalesce(users, 0) AS users, coalesce(e, 0) AS error_count, coalesce(c, 0) AS crash_count
    FROM (SELECT device_model, CAST(m AS DATE) AS d FROM (SELECT DISTINCT device_model FROM page_flow),
          generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '{_D}', INTERVAL 1 DAY) g(m))
    LEFT JOIN (SELECT device_model, log_date AS d, count(DISTINCT device_id) AS users, CAST(sum(error_count) AS BIGINT) AS e,
               CAST(sum(crash_count) AS BIGINT) AS c FROM page_flow GROUP BY 1, 2) USING (device_model, d)
    """,
)
def _(t: Tables):
    return widgets.device_series(t.pages, dtb.FIRST_DAY, _D, "day")


_PAGE_COLS = """
count(*) AS cnt, CAST(sum(log_count) AS BIGINT) AS log_count, CAST(sum(sum_cpu_usage) AS BIGINT) AS sum_cpu_usage,
CAST(sum(sum_mem_usage) AS BIGINT) AS sum_mem_usage, CAST(round_even(coalesce(avg(loading_time), 0), 0) AS BIGINT) AS loading_time,
CAST(round_even(coalesce(sum(response_time) / nullif(sum(request_count), 0), 0), 0) AS BIGINT) AS response_time,
CAST(round_even(coalesce(avg(intervaltime), 0), 0) AS BIGINT) AS intervaltime, CAST(sum(error_count) AS BIGINT) AS error_count,
CAST(sum(crash_count) AS BIGINT) AS crash_count, CAST(round_even(sum(sum_cpu_usage) / sum(log_count), 0) AS BIGINT) AS cpu_usage,
CAST(round_even(sum(sum_mem_usage) / sum(log_count), 0) AS BIGINT) AS mem_usage
"""
_TOP_PAGES = f"""
tops AS (
  SELECT package_nm, server_type, os_type, page_name, {_PAGE_COLS}, count(DISTINCT device_id) AS device_count
  FROM page_flow WHERE log_date = DATE '{_D}' GROUP BY 1, 2, 3, 4
  QUALIFY row_number() OVER (PARTITION BY package_nm, server_type, os_type ORDER BY count(*) DESC, page_name) <= 30)
"""


@query("top_pages", "SELECT * FROM tops", ctes=_TOP_PAGES)
def _(t: Tables):
    return widgets.top_pages(t.page_daily, _D)


@query(
    "page_list",
    f"SELECT page_name, {_PAGE_COLS} FROM page_flow WHERE log_date >= DATE '2024-01-10' AND log_date < DATE '2024-01-20' GROUP BY 1 ORDER BY cnt DESC, page_name LIMIT 6 OFFSET 5",
)
def _(t: Tables):
    return widgets.page_list(t.page_daily, dt.date(2024, 1, 10), dt.date(2024, 1, 20), 5, 5)


@query(
    "page_series",
    f"""
    SELECT page_name, m AS hour_ms, coalesce(n, 0) AS cnt, coalesce(e, 0) AS error_count, coalesce(c, 0) AS crash_count,
           coalesce(l, 0) AS loading, coalesce(r, 0) AS response
    FROM (SELECT * FROM (SELECT DISTINCT page_name FROM page_flow WHERE log_date = DATE '{_D}'),
          generate_series(epoch_ms(TIMESTAMP '{_D}'), epoch_ms(TIMESTAMP '{_D}') + 82800000, 3600000) g(m))
    LEFT JOIN (SELECT page_name, page_start_tm // 3600000 * 3600000 AS m, count(*) AS n, CAST(sum(error_count) AS BIGINT) AS e, CAST(sum(crash_count) AS BIGINT) AS c,
        CAST(round_even(quantile_cont(loading_time, 0.5), 0) AS BIGINT) AS l, CAST(round_even(avg(response_time), 0) AS BIGINT) AS r
        FROM page_flow WHERE log_date = DATE '{_D}' GROUP BY 1, 2) USING (page_name, m)
    """,
)
def _(t: Tables):
    return widgets.page_series(t.pages, _D)


@query(
    "page_series_daily",
    """
    SELECT page_name, CAST(d AS VARCHAR) AS log_date, coalesce(n, 0) AS cnt, coalesce(e, 0) AS error_count, coalesce(c, 0) AS crash_count,
           coalesce(l, 0) AS loading, coalesce(r, 0) AS response
    FROM (SELECT page_name, CAST(m AS DATE) AS d FROM (SELECT DISTINCT page_name FROM page_flow),
          generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) g(m))
    LEFT JOIN (SELECT page_name, log_date AS d, count(*) AS n, CAST(sum(error_count) AS BIGINT) AS e, CAST(sum(crash_count) AS BIGINT) AS c,
        CAST(round_even(avg(loading_time), 0) AS BIGINT) AS l, CAST(round_even(sum(response_time) / nullif(sum(request_count), 0), 0) AS BIGINT) AS r
        FROM page_flow GROUP BY 1, 2) USING (page_name, d)
    """,
)
def _(t: Tables):
    return widgets.page_series_daily(t.page_daily, dt.date(2024, 1, 20), dt.date(2024, 2, 2))


@query(
    "merge_by_url",
    """
    SELECT page_name, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(log_count) AS BIGINT) AS log_count, CAST(sum(device_count) AS BIGINT) AS device_count,
           CAST(sum(sum_cpu_usage) AS BIGINT) AS sum_cpu_usage, CAST(sum(sum_mem_usage) AS BIGINT) AS sum_mem_usage,
           CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(crash_count) AS BIGINT) AS crash_count,
           CAST(round_even(sum(loading_time * cnt) / sum(cnt), 0) AS BIGINT) AS loading_time,
           CAST(round_even(sum(response_time * cnt) / sum(cnt), 0) AS BIGINT) AS response_time,
           CAST(round_even(sum(intervaltime * cnt) / sum(cnt), 0) AS BIGINT) AS intervaltime,
           CAST(round_even(sum(sum_cpu_usage) / sum(log_count), 0) AS BIGINT) AS cpu_usage,
           CAST(round_even(sum(sum_mem_usage) / sum(log_count), 0) AS BIGINT) AS mem_usage
    FROM tops GROUP BY 1
    """,
    ctes=_TOP_PAGES,
)
def _(t: Tables):
    return widgets.merge_by_url(widgets.top_pages(t.page_daily, _D))


@query(
    "priority_pages",
    """
    SELECT package_nm, server_type, os_type, page_name, cnt, type, position FROM (
      SELECT *, row_number() OVER (PARTITION BY package_nm, server_type, os_type ORDER BY type DESC, rank) AS pos,
             count(*) FILTER (type > 0) OVER (PARTITION BY package_nm, server_type, os_type) AS trouble,
             CASE WHEN trouble >= 8 AND type = 0 THEN CASE WHEN rank = 1 THEN 8 END WHEN trouble >= 8 AND pos >= 8 THEN NULL ELSE pos END AS position
      FROM ranked WHERE rank <= CASE type WHEN 0 THEN 8 ELSE 4 END) WHERE position <= 8
    """,
    ctes=f"""
    counts AS (SELECT package_nm, server_type, os_type, page_name, CAST(sum(crash_count) AS BIGINT) AS c, CAST(sum(error_count) AS BIGINT) AS e, CAST(sum(log_count) AS BIGINT) AS l
               FROM page_flow WHERE log_date = DATE '{_D}' GROUP BY 1, 2, 3, 4),
    long AS (SELECT package_nm, server_type, os_type, page_name, c AS cnt, 2 AS type FROM counts WHERE c > 0 UNION ALL
             SELECT package_nm, server_type, os_type, page_name, e, 1 FROM counts WHERE e > 0 UNION ALL
             SELECT package_nm, server_type, os_type, page_name, l, 0 FROM counts WHERE l > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY package_nm, server_type, os_type, type ORDER BY cnt DESC, page_name DESC) AS rank FROM long)
    """,
)
def _(t: Tables):
    return widgets.priority_pages(t.page_daily, _D, each=4, limit=8)


@query(
    "page_view_series_hourly",
    f"""
    SELECT page_name, CAST(date_trunc('hour', page_start_tm_dt) AS VARCHAR) AS bucket, count(*) AS views, count(DISTINCT device_id) AS viewers
    FROM page_flow WHERE page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return widgets.page_view_series(t.pages, START, END)


@query(
    "page_view_series_daily",
    f"""
    SELECT page_name, CAST(CAST(page_start_tm_dt + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS bucket, count(*) AS views, count(DISTINCT device_id) AS viewers
    FROM page_flow WHERE page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return widgets.page_view_series(t.pages, START, END, "day", tz="Asia/Seoul")


_RESOURCE_TOP = _MODELS + """,
best AS (SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY package_nm, server_type, os_type ORDER BY device_count DESC, device_model) <= 6)
"""


@query(
    "resource_top",
    """
    SELECT package_nm, server_type, os_type, device_model, device_count, log_count, round_even(sum_cpu_usage / log_count, 1) AS cpu_usage,
           CAST(round_even(sum_mem_usage / log_count, 0) AS BIGINT) AS mem_usage FROM best
    """,
    ctes=_RESOURCE_TOP,
)
def _(t: Tables):
    return widgets.resource_top(*model_frames(t), _D)


@query(
    "resource_series",
    f"""
    SELECT package_nm, server_type, os_type, device_model, CAST(date_trunc('hour', page_start_tm_dt) AS VARCHAR) AS hour_bucket,
           CAST(sum(log_count) AS BIGINT) AS log_count, CAST(sum(p.sum_cpu_usage) // sum(log_count) AS BIGINT) AS avg_cpu_usage,
           CAST(sum(p.sum_mem_usage) // sum(log_count) AS BIGINT) AS avg_mem_usage
    FROM page_flow p SEMI JOIN best USING (package_nm, server_type, os_type, device_model) WHERE log_date = DATE '{_D}' GROUP BY 1, 2, 3, 4, 5
    QUALIFY row_number() OVER (PARTITION BY package_nm, server_type, os_type, device_model ORDER BY hour_bucket DESC) <= 12
    """,
    ctes=_RESOURCE_TOP,
)
def _(t: Tables):
    return widgets.resource_series(*model_frames(t), _D, tail=12)


@query(
    "resource_models",
    """
    SELECT package_nm, server_type, os_type, device_model, device_count, log_count, sum_cpu_usage, sum_mem_usage,
           (SELECT CAST(sum(device_count) AS BIGINT) FROM models) AS total_count, (SELECT CAST(sum(log_count) AS BIGINT) FROM models) AS total_log_count,
           (SELECT count(*) FROM models) AS total_rows
    FROM models ORDER BY device_count DESC, device_model, package_nm, server_type, os_type LIMIT 9 OFFSET 4
    """,
    ctes=_MODELS,
)
def _(t: Tables):
    return widgets.resource_models(*model_frames(t), _D, 8, 4)


@query(
    "resource_join",
    """
    SELECT device_model, round(avg(sum_cpu_usage), 6) AS cpu_usage, round(avg(sum_mem_usage), 6) AS mem_usage, count(*) AS usage_count, max(users) AS users
    FROM page_flow JOIN (SELECT device_model, count(DISTINCT device_id) AS users FROM event_log WHERE log_type IN (1048597, 131073) GROUP BY 1) USING (device_model)
    GROUP BY 1
    """,
)
def _(t: Tables):
    return widgets.resource_join(t.pages, t.events.filter(F.col("log_type").isin(*VISITS)))


@query(
    "pv_list",
    """
    SELECT page_name, count(*) AS view_count, count(DISTINCT device_id) AS device_count, round(avg(intervaltime), 6) AS intervaltime
    FROM page_flow WHERE log_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 3
    """,
)
def _(t: Tables):
    devices = rollup.rollup_devices(t.pages, ["log_date", "page_name"])
    return widgets.pv_list(t.page_daily, devices, dt.date(2024, 1, 10), dt.date(2024, 1, 20), 5, 3)


@query(
    "pv_detail",
    f"""
    SELECT page_start_tm, device_id, user_id, intervaltime, loading_time FROM page_flow
    WHERE page_name = 'https://app/p3' AND page_start_tm >= {START} AND page_start_tm < {END} ORDER BY page_start_tm DESC, device_id LIMIT 40 OFFSET 20
    """,
)
def _(t: Tables):
    return widgets.pv_detail(t.pages, START, END, "https://app/p3", 40, 20)


@query(
    "pv_chart",
    f"""
    SELECT page_name, page_start_tm // 3600000 * 3600000 AS hour_ms, round(avg(intervaltime), 6) AS stay_time, round(avg(loading_time), 6) AS loading_time
    FROM page_flow WHERE page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return widgets.pv_chart(t.pages, START, END)


_T = ["log_tm", "device_id", "log_type", "log_name"]


@query("trouble_list_crash", "SELECT log_tm, device_id, log_type, log_name FROM trouble_log WHERE log_type = 2097152 ORDER BY log_tm DESC, device_id LIMIT 101")
def _(t: Tables):
    return widgets.trouble_list(t.trouble, lt.CRASH, 100).select(*_T)


@query("trouble_list_error", "SELECT log_tm, device_id, log_type, log_name FROM trouble_log WHERE log_type <> 2097152 AND os_type = 'iOS' ORDER BY log_tm DESC, device_id LIMIT 101")
def _(t: Tables):
    return widgets.trouble_list(t.trouble, lt.SCRIPT_ERROR, 100, os_type="iOS").select(*_T)


@query(
    "row_detail",
    """
    SELECT device_id, log_type, log_tm, event_id, req_url FROM event_log WHERE (device_id, log_type) IN (SELECT device_id, log_type FROM event_log WHERE status_code = 500)
    QUALIFY row_number() OVER (PARTITION BY device_id, log_type ORDER BY log_tm DESC, event_id DESC) = 1
    """,
)
def _(t: Tables):
    rows = t.events.select("device_id", "log_type", "log_tm", "event_id", "req_url")
    return widgets.row_detail(rows, ["device_id", "log_type"], "log_tm", t.events.filter("status_code = 500"), ["event_id"])


@query(
    "scatter_sample_latest",
    """
    SELECT event_id, package_nm, intervaltime, log_tm FROM event_log WHERE intervaltime >= 1500
    UNION ALL (SELECT event_id, package_nm, intervaltime, log_tm FROM event_log WHERE intervaltime < 1500
      QUALIFY row_number() OVER (PARTITION BY package_nm, server_type ORDER BY log_tm DESC, event_id) <= 400)
    """,
)
def _(t: Tables):
    sample = widgets.scatter_sample(t.events, "intervaltime", "log_tm", ["event_id"], "latest", elapsed_s=60)
    return sample.select("event_id", "package_nm", "intervaltime", "log_tm")


@query(
    "scatter_sample_all",
    """
    SELECT package_nm, count(*) AS cnt, count(*) FILTER (intervaltime >= 1500) AS slow FROM (
      SELECT * FROM event_log WHERE intervaltime >= 1500 UNION ALL
      (SELECT * FROM event_log WHERE intervaltime < 1500 QUALIFY row_number() OVER (PARTITION BY package_nm, server_type ORDER BY event_id) <= 2000)) GROUP BY 1
    """,
)
def _(t: Tables):
    sample = widgets.scatter_sample(t.events, "intervaltime", "log_tm", ["event_id"])
    return sample.groupBy("package_nm").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("intervaltime") >= 1500).alias("slow"))


def increments(t: Tables):
    rows = t.events.select("event_id", "device_id", "log_tm", "intervaltime")
    old = rows.filter(F.col("log_tm") < END)
    new = rows.filter(F.col("log_tm") >= START).withColumn("intervaltime", F.col("intervaltime") + 1)
    return old, new


@query("merge_increment_new", f"SELECT event_id, device_id, log_tm, intervaltime + 1 AS intervaltime FROM event_log WHERE log_tm >= {END}")
def _(t: Tables):
    return widgets.merge_increment(*increments(t), ["event_id"], "log_tm", F.lit(START - tg.DAY))[0]


@query(
    "merge_increment_state",
    f"""
    SELECT event_id, device_id, log_tm, intervaltime + CASE WHEN log_tm >= {START} THEN 1 ELSE 0 END AS intervaltime FROM event_log WHERE log_tm >= {START - tg.DAY}
    """,
)
def _(t: Tables):
    return widgets.merge_increment(*increments(t), ["event_id"], "log_tm", F.lit(START - tg.DAY))[1]


@query("scatter_since", f"SELECT log_tm || '_' || device_id || '_' || log_type AS row_id, intervaltime FROM event_log WHERE log_tm > {END} AND os_type = 'Android'")
def _(t: Tables):
    return widgets.scatter_since(t.events, END, ["log_tm", "device_id", "log_type"], "Android").select("row_id", "intervaltime")


@query(
    "device_analysis",
    """
    SELECT *, CAST(sum(users) OVER () AS BIGINT) AS total_users, CAST(sum(error_count) OVER () AS BIGINT) AS total_error_count,
           CAST(sum(crash_count) OVER () AS BIGINT) AS total_crash_count
    FROM (SELECT device_model, count(DISTINCT device_id) AS users, min(os_type) AS os_type FROM event_log WHERE log_type IN (1048597, 131073) GROUP BY 1)
    LEFT JOIN (SELECT device_model, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(crash_count) AS BIGINT) AS crash_count FROM page_flow GROUP BY 1) USING (device_model)
    """,
)
def _(t: Tables):
    return widgets.device_analysis(t.events.filter(F.col("log_type").isin(*VISITS)), t.pages)


@query(
    "trouble_by_location",
    f"""
    SELECT log_tm, device_id, log_type, k % 17 || '' AS location_code FROM trouble_log WHERE log_date = DATE '{_D}' - 1 AND log_type = 131077
    ORDER BY log_tm DESC, device_id LIMIT 50
    """,
)
def _(t: Tables):
    rows = t.trouble.withColumn("location_code", (F.col("k") % 17).cast("string"))
    return widgets.trouble_by_location(rows, _D, "error").select("log_tm", "device_id", "log_type", "location_code")


@query(
    "other_bucket",
    """
    SELECT os_type, count(*) AS cnt, count(DISTINCT device_id) AS devices FROM event_log ANTI JOIN best USING (os_type, device_model) GROUP BY 1
    """,
    ctes="""
    best AS (SELECT os_type, device_model FROM event_log GROUP BY 1, 2
             QUALIFY row_number() OVER (PARTITION BY os_type ORDER BY count(DISTINCT device_id) DESC, device_model) <= 5)
    """,
)
def _(t: Tables):
    return widgets.other_bucket(t.events, "device_model", ["os_type"])


@query(
    "urls_without_alias",
    f"""
    SELECT page_name, count(*) AS cnt FROM page_flow WHERE log_date = DATE '{_D}' AND page_name NOT IN ('https://app/p1', 'https://app/p2')
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
    """,
)
def _(t: Tables):
    alias = literal_frame(t.spark, [("https://app/p1", "one"), ("https://app/p2", "two")], ["page_name", "alias"])
    return widgets.urls_without_alias(t.pages, alias, _D)


@query(
    "with_display_names",
    """
    SELECT CASE device_model WHEN 'M1' THEN 'Model one' WHEN 'M2' THEN 'Model two' ELSE device_model END AS model_name, count(*) AS cnt FROM event_log GROUP BY 1
    """,
)
def _(t: Tables):
    names = literal_frame(t.spark, [("M1", "Model one"), ("M2", "Model two"), ("M3", "")], ["model", "name"])
    named = widgets.with_display_names(t.events, "device_model", names, "model", "name", "model_name")
    return named.groupBy("model_name").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "trouble_by_page",
    f"""
    SELECT log_tm, device_id, log_type FROM trouble_log WHERE split_part(req_url, '?', 1) = 'https://app/p4' AND log_type = 131077
      AND (log_tm < {END} OR (log_tm = {END} AND device_id < 'd5')) ORDER BY log_tm DESC, device_id DESC, log_type DESC LIMIT 50
    """,
)
def _(t: Tables):
    rows = t.trouble.withColumn("page_name", F.substring_index("req_url", "?", 1))
    return widgets.trouble_by_page(rows, "https://app/p4", "error", 50, (END, "d5", 0)).select("log_tm", "device_id", "log_type")
