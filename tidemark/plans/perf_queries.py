"""Performance analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import literal_frame
from tidemark.operators import perf
from tidemark.plans.registry import Tables, query
from tidemark.sources import driver_tables as dtb

_D = dtb.AS_OF
START, END = tg.millis(dt.date(2024, 1, 8)), tg.millis(dt.date(2024, 1, 22))
DAY = tg.millis(_D)


def _steps(start: int, end: int, width: int) -> str:
    return f"(SELECT g.m AS bucket_ms FROM generate_series({start}, {end - 1}, {width}) g(m))"


def _filled(rows: str, ts: str, width: int, start: int, end: int, aggs: str, cols: str, by: str = "") -> str:
    """Check SQL of a zero-filled series."""
    keys = f"{by}, bucket_ms" if by else "bucket_ms"
    lead = f"{by}, " if by else ""
    grid = _steps(start, end, width)
    if by:
        grid = f"(SELECT * FROM (SELECT DISTINCT {by} FROM {rows} WHERE {ts} >= {start} AND {ts} < {end}), {grid})"
    return f"""SELECT {keys}, {cols} FROM {grid} LEFT JOIN (SELECT {lead}{ts} // {width} * {width} AS bucket_ms, {aggs} FROM {rows}
      WHERE {ts} >= {start} AND {ts} < {end} GROUP BY {'1, 2' if by else '1'}) USING ({keys})"""


@query("minute_trend", _filled("page_flow", "page_start_tm", tg.MINUTE, DAY, DAY + tg.DAY, "CAST(sum(error_count) AS BIGINT) AS n", "coalesce(n, 0) AS cnt"))
def _(t: Tables):
    return perf.minute_trend(t.pages, "error", DAY, DAY + tg.DAY)


@query("hour_trend_crash", _filled("page_flow", "page_start_tm", tg.HOUR, START, END, "CAST(sum(crash_count) AS BIGINT) AS n", "coalesce(n, 0) AS cnt"))
def _(t: Tables):
    return perf.minute_trend(t.pages, "crash", START, END, "1h")


@query("trend_no_fill", f"SELECT page_start_tm // 600000 * 600000 AS bucket_ms, count(*) AS cnt FROM page_flow WHERE page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1")
def _(t: Tables):
    return perf.minute_trend(t.pages, "count", START, END, "10m", fill=False)


@query(
    "minute_stats",
    f"""
    SELECT page_start_tm // 60000 * 60000 AS bucket_ms, min(loading_time) AS min_value, round(avg(loading_time), 6) AS avg_value, max(loading_time) AS max_value,
           count(*) AS cnt FROM page_flow WHERE loading_time > 0 AND page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.minute_stats(t.pages, "loading_time", "page_start_tm", START, END)


@query(
    "minute_stats_response",
    f"""
    SELECT log_tm // 60000 * 60000 AS bucket_ms, min(intervaltime) AS min_value, CAST(sum(intervaltime) AS BIGINT) AS sum_value, max(intervaltime) AS max_value,
           count(*) AS cnt FROM network_log WHERE intervaltime > 0 AND log_tm >= {START} AND log_tm < {END} GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.minute_stats(t.network, "intervaltime", "log_tm", START, END, total=True)


@query(
    "url_model_stats",
    """
    SELECT page_name, device_model, count(*) AS cnt, min(loading_time) AS min_value, round(avg(loading_time), 6) AS avg_value, max(loading_time) AS max_value,
           quantile_cont(loading_time, 0.5) AS med_value
    FROM page_flow WHERE loading_time > 0 AND (page_name > 'https://app/p2' OR (page_name = 'https://app/p2' AND device_model > 'M15')) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 40
    """,
)
def _(t: Tables):
    return perf.url_model_stats(t.pages, "loading_time", 40, ("https://app/p2", "M15"), median=True)


@query(
    "slowest_models",
    "SELECT device_model, round(avg(intervaltime), 6) AS avg_value, count(*) AS cnt FROM network_log WHERE intervaltime > 0 AND os_type = 'Android' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t: Tables):
    return perf.slowest_models(t.network, "intervaltime", 10, "Android")


@query(
    "pv_urls",
    f"""
    SELECT page_name, count(*) AS cnt, count(DISTINCT device_id) AS devices, CAST(sum(response_time) AS BIGINT) AS response_time, CAST(sum(request_count) AS BIGINT) AS request_count,
           CAST(sum(loading_time) AS BIGINT) AS loading_time, CAST(sum(intervaltime) AS BIGINT) AS intervaltime
    FROM page_flow WHERE page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.pv_urls(t.pages, START, END)


@query(
    "log_search",
    f"""
    SELECT event_id, log_tm, device_id, log_type FROM event_log WHERE log_tm >= {START} AND log_tm < {END} AND log_type IN (131077, 2097152, 524291)
      AND ((os_type = 'Android' AND app_ver IN ('1.0', '1.2')) OR (os_type = 'iOS' AND app_ver IN ('1.1'))) AND lower(req_url) LIKE '%p1%'
    ORDER BY log_tm DESC, device_id DESC, log_type DESC LIMIT 100
    """,
)
def _(t: Tables):
    cond = perf.log_filter(
        [lt.SCRIPT_ERROR, lt.CRASH, lt.HTTP_RESPONSE], {"Android": ["1.0", "1.2"], "iOS": ["1.1"]}, {"req_url": ("contains", "P1")}
    )
    return perf.log_search(t.events, START, END, 100, cond).select("event_id", "log_tm", "device_id", "log_type")


@query(
    "keyset_page",
    f"""
    SELECT event_id, log_tm, device_id, log_type FROM event_log WHERE log_tm >= {START} AND log_tm < {END}
      AND (log_tm, device_id, log_type) < ({END - tg.DAY}, 'd50', 131077) ORDER BY log_tm DESC, device_id DESC, log_type DESC LIMIT 100
    """,
)
def _(t: Tables):
    rows = perf.log_search(t.events, START, END, 100, after=(END - tg.DAY, "d50", lt.SCRIPT_ERROR))
    return rows.select("event_id", "log_tm", "device_id", "log_type")


@query(
    "url_model_rows",
    "SELECT page_id, page_start_tm, device_id, loading_time FROM page_flow WHERE page_name = 'https://app/p3' AND device_model = 'M7' ORDER BY page_start_tm DESC, device_id LIMIT 500",
)
def _(t: Tables):
    return perf.url_model_rows(t.pages, "https://app/p3", "M7", "page_start_tm", 500).select("page_id", "page_start_tm", "device_id", "loading_time")


_CELLS = f"""
cells AS (SELECT page_end_tm // 1800000 * 1800000 AS bucket_ms, loading_time // 500 * 500 AS duration, count(*) AS cnt
  FROM page_flow WHERE log_type = 131073 AND page_end_tm BETWEEN {START} AND {END} AND loading_time IS NOT NULL GROUP BY 1, 2)
"""


@query("heatmap", "SELECT *, (SELECT greatest(max(duration), 2000) FROM cells) AS max_duration FROM cells", ctes=_CELLS)
def _(t: Tables):
    web = t.pages.filter(F.col("log_type").isin(*lt.WEB_PAGE))
    return perf.heatmap(web, "loading_time", "page_end_tm", START, END, 30, 500)


@query(
    "heatmap_urls",
    f"""
    SELECT page_name, round(avg(loading_time), 6) AS avg_value, count(*) AS cnt, CAST(sum(error_count) AS BIGINT) AS error_count
    FROM page_flow WHERE page_start_tm BETWEEN {START} AND {END} AND loading_time BETWEEN 500 AND 1500 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1000
    """,
)
def _(t: Tables):
    return perf.heatmap_urls(perf.in_cell(t.pages, "loading_time", "page_start_tm", START, END, 500, 1500), "loading_time", 1000)


@query(
    "perf_rows",
    f"""
    SELECT page_id, page_start_tm, loading_time FROM page_flow WHERE page_start_tm BETWEEN {START} AND {END} AND loading_time BETWEEN 500 AND 1500
    ORDER BY page_start_tm DESC, device_id LIMIT 1000
    """,
)
def _(t: Tables):
    cell = perf.in_cell(t.pages, "loading_time", "page_start_tm", START, END, 500, 1500)
    return perf.perf_rows(cell, "page_start_tm", 1000).select("page_id", "page_start_tm", "loading_time")


@query("response_chart", _filled("network_log", "log_tm", tg.MINUTE, DAY, DAY + tg.DAY, "CAST(round(avg(intervaltime), 0) AS BIGINT) AS r", "coalesce(r, 0) AS response"))
def _(t: Tables):
    return perf.response_chart(t.network, DAY, DAY + tg.DAY)


@query(
    "percentiles_rank",
    f"""
    SELECT req_url AS url, count(*) AS cnt, round(quantile_cont(intervaltime, 0.05), 6) AS top, round(quantile_cont(intervaltime, 0.95), 6) AS bottom,
           round(avg(CASE WHEN intervaltime <= 1200 THEN 100.0 ELSE 0.0 END), 6) AS rank
    FROM network_log WHERE log_tm BETWEEN {END - 240 * tg.HOUR} AND {END} GROUP BY 1
    """,
)
def _(t: Tables):
    rows = perf.percentiles_rank(t.network, END, 240, 1200)
    return rows.select("url", "cnt", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), "rank")


@query("value_histogram", "SELECT os_type, intervaltime // 250 * 250 AS bucket, count(*) AS cnt FROM network_log WHERE intervaltime BETWEEN 100 AND 9000 GROUP BY 1, 2")
def _(t: Tables):
    return perf.value_histogram(t.network, "intervaltime", 250, 100, 9000, ["os_type"])


@query(
    "median_times",
    f"""
    SELECT page_name, quantile_cont(loading_time, 0.5) AS med_loading, quantile_cont(response_time, 0.5) FILTER (request_count > 0) AS med_response
    FROM page_flow WHERE log_date BETWEEN DATE '{_D}' - 3 AND DATE '{_D}' GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.median_times(t.pages, "page_name", _D)


@query(
    "median_times_by_model",
    f"""
    SELECT device_model, quantile_cont(loading_time, 0.5) AS med_loading, quantile_cont(response_time, 0.5) FILTER (request_count > 0) AS med_response
    FROM page_flow WHERE log_date BETWEEN DATE '{_D}' - 3 AND DATE '{_D}' GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.median_times(t.pages, "device_model", _D)


@query(
    "model_ratio",
    """
    SELECT os_type, device_model, med_loading, avg_response, calls
    FROM (SELECT os_type, device_model, quantile_cont(loading_time, 0.5) AS med_loading FROM page_flow GROUP BY 1, 2)
    FULL JOIN (SELECT os_type, device_model, round(avg(intervaltime), 6) AS avg_response, count(*) AS calls FROM network_log GROUP BY 1, 2) USING (os_type, device_model)
    """,
)
def _(t: Tables):
    return perf.model_ratio(t.pages, t.network)


@query(
    "usage_by_model",
    """
    SELECT *, max(usage) OVER () AS max_usage, min(usage) OVER () AS min_usage, round(avg(usage) OVER (), 6) AS avg_usage FROM (
      SELECT device_model, round(avg(sum_cpu_usage), 6) AS usage, max(os_type) AS os_type FROM page_flow GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7)
    """,
)
def _(t: Tables):
    return perf.usage_by_model(t.pages, "sum_cpu_usage")


@query(
    "metric_stats",
    """
    SELECT package_nm, CAST(min(nullif(sum_cpu_usage, 0)) AS BIGINT) AS min_sum_cpu_usage, CAST(max(nullif(sum_cpu_usage, 0)) AS BIGINT) AS max_sum_cpu_usage,
           round(avg(nullif(sum_cpu_usage, 0)), 6) AS avg_sum_cpu_usage, min(nullif(loading_time, 0)) AS min_loading_time,
           max(nullif(loading_time, 0)) AS max_loading_time, round(avg(nullif(loading_time, 0)), 6) AS avg_loading_time FROM page_flow GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.metric_stats(t.pages, ["sum_cpu_usage", "loading_time"], ["package_nm"])


@query(
    "daily_percentile",
    """
    SELECT CAST(day AS VARCHAR) AS day, os_type, max(med) AS med_value, max(p) AS p_value, max(loading_time) AS max_value, min(loading_time) AS min_value,
           count(*) FILTER (loading_time >= p) AS tail_count, round(avg(loading_time) FILTER (loading_time >= p), 6) AS tail_avg
    FROM rows JOIN (SELECT day, os_type, round(quantile_cont(loading_time, 0.5), 6) AS med, round(quantile_cont(loading_time, 0.9), 6) AS p FROM rows GROUP BY 1, 2) USING (day, os_type)
    GROUP BY 1, 2
    """,
    ctes="rows AS (SELECT *, CAST(page_start_tm_dt + INTERVAL 9 HOUR AS DATE) AS day FROM page_flow WHERE loading_time IS NOT NULL)",
)
def _(t: Tables):
    found = perf.daily_percentile(t.pages, "loading_time", 0.9, "Asia/Seoul")
    return found.withColumn("p_value", F.round("p_value", 6)).withColumn("med_value", F.round("med_value", 6))


@query(
    "top20_models",
    """
    SELECT device_model, max(loading_time) AS max_value, count(DISTINCT device_id) AS devices, max(os_type) AS os_type, quantile_cont(loading_time, 0.5) AS med_value
    FROM page_flow WHERE loading_time IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
)
def _(t: Tables):
    return perf.top20_models(t.pages, "loading_time", 10)


@query(
    "vital_rating",
    """
    SELECT name, CAST(trunc(count(*) FILTER (rating = 'good') * 100.0 / count(*)) AS BIGINT) AS good,
           CAST(trunc(count(*) FILTER (rating = 'needs-improvement') * 100.0 / count(*)) AS BIGINT) AS needs_improvement,
           CAST(trunc(count(*) FILTER (rating = 'poor') * 100.0 / count(*)) AS BIGINT) AS poor FROM vital_log GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.vital_rating(t.vitals)


@query("vital_trend", _filled("vital_log", "log_tm", 5 * tg.MINUTE, DAY, DAY + tg.DAY, "avg(value) AS v", "coalesce(v, 0) AS avg_value", "name"))
def _(t: Tables):
    return perf.vital_trend(t.vitals, DAY, DAY + tg.DAY)


@query(
    "vital_means",
    "SELECT round(avg(value) FILTER (name = 'lcp'), 6) AS lcp, round(avg(value) FILTER (name = 'inp'), 6) AS inp, round(avg(value) FILTER (name = 'cls'), 6) AS cls, round(avg(value) FILTER (name = 'fcp'), 6) AS fcp FROM vital_log",
)
def _(t: Tables):
    return perf.vital_means(t.vitals)


@query(
    "vitals_by_page",
    """
    SELECT page_name, round(avg(lcp), 6) AS lcp, round(avg(inp), 6) AS inp, round(avg(cls), 6) AS cls, round(avg(fcp), 6) AS fcp,
           coalesce(round(avg(loading_time), 6), 0) AS loading_avg, count(*) AS cnt FROM page_flow WHERE log_type = 131073 GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.vitals_by_page(t.pages)


@query(
    "latest_vitals",
    "SELECT page_id, name, arg_max(value, log_tm) AS value FROM vital_log WHERE page_id IN (SELECT page_id FROM page_flow WHERE error_count > 0) GROUP BY 1, 2",
)
def _(t: Tables):
    return perf.latest_vitals(t.vitals, t.pages.filter("error_count > 0"))


@query(
    "api_errors",
    "SELECT req_url, status_code, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS ratio FROM network_log WHERE status_group IN ('3xx', '4xx', '5xx') GROUP BY 1, 2",
)
def _(t: Tables):
    return perf.api_errors(t.network)


@query(
    "api_error_chart",
    _filled("failed", "log_tm", 5 * tg.MINUTE, DAY, DAY + tg.DAY, "count(*) AS n", "coalesce(n, 0) AS cnt", "status_group"),
    ctes="failed AS (SELECT * FROM network_log WHERE status_group IN ('3xx', '4xx', '5xx'))",
)
def _(t: Tables):
    return perf.api_error_chart(t.network, DAY, DAY + tg.DAY)


@query(
    "api_error_rows",
    "SELECT event_id, log_tm, device_id FROM network_log WHERE req_url = 'https://app/p3?k=15' AND status_code = 500 ORDER BY log_tm DESC, device_id LIMIT 1000",
)
def _(t: Tables):
    return perf.api_error_rows(t.network, "https://app/p3?k=15", 500, 1000).select("event_id", "log_tm", "device_id")


@query(
    "page_aggregate",
    """
    SELECT page_name, round(avg(lcp) FILTER (lcp > 0), 6) AS lcp_avg, round(avg(inp) FILTER (inp > 0), 6) AS inp_avg, round(avg(cls) FILTER (cls > 0), 6) AS cls_avg,
           round(avg(loading_time), 6) AS loading_time, count(DISTINCT device_id) AS users
    FROM page_flow WHERE log_type IN (131073, 1048592) AND page_name LIKE '%/p%' AND page_name > 'https://app/p1' GROUP BY 1 ORDER BY 1 LIMIT 8
    """,
)
def _(t: Tables):
    return perf.page_aggregate(t.pages, 8, "/p", after="https://app/p1")


@query(
    "network_aggregate",
    """
    SELECT req_url, round(avg(intervaltime), 6) AS response_time, count(*) FILTER (status_group = '2xx') AS s2xx, count(*) FILTER (status_group = '4xx') AS s4xx,
           count(*) FILTER (status_group = '5xx') AS s5xx, count(DISTINCT device_id) AS users FROM network_log GROUP BY 1
    """,
)
def _(t: Tables):
    return perf.network_aggregate(t.network)


@query("error_aggregate", "SELECT log_name, count(*) AS cnt, count(DISTINCT device_id) AS users FROM trouble_log WHERE log_type = 131077 GROUP BY 1")
def _(t: Tables):
    return perf.error_aggregate(t.trouble)


@query(
    "dimension_ratio",
    """
    SELECT os_type, app_ver, count(*) AS cnt, round(avg(lcp) FILTER (lcp > 0), 6) AS lcp_avg, round(avg(inp) FILTER (inp > 0), 6) AS inp_avg,
           round(avg(cls) FILTER (cls > 0), 6) AS cls_avg, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS rate FROM page_flow WHERE log_type = 131073 GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return perf.dimension_ratio(t.pages, ["os_type", "app_ver"])


@query("half_hour_series", _filled("page_flow", "page_start_tm", 30 * tg.MINUTE, START, END, "count(*) AS n", "coalesce(n, 0) AS cnt"))
def _(t: Tables):
    return perf.half_hour_series(t.pages, "page_start_tm", dt.date(2024, 1, 8), dt.date(2024, 1, 21))


@query("half_hour_users", _filled("event_log", "log_tm", 30 * tg.MINUTE, START, END, "count(DISTINCT device_id) AS n", "coalesce(n, 0) AS cnt"))
def _(t: Tables):
    return perf.half_hour_series(t.events, "log_tm", dt.date(2024, 1, 8), dt.date(2024, 1, 21), users=True)


@query(
    "ten_min_series",
    _filled(
        "page_flow", "page_start_tm", 10 * tg.MINUTE, DAY, DAY + tg.DAY, "round(avg(loading_time), 6) AS v, count(*) AS n",
        f"""coalesce(v, 0) AS avg_value, coalesce(n, 0) AS cnt, (SELECT round(avg(loading_time), 6) FROM page_flow WHERE log_date = DATE '{_D}') AS total_avg,
        (SELECT count(*) FROM page_flow WHERE log_date = DATE '{_D}') AS total""",
    ),
)
def _(t: Tables):
    return perf.ten_min_series(t.pages, "page_start_tm", "loading_time", DAY, DAY + tg.DAY)


@query(
    "list_with_mean",
    """
    SELECT page_id, page_start_tm, loading_time, (SELECT round(avg(loading_time), 6) FROM page_flow WHERE loading_time BETWEEN 200 AND 900 AND os_type = 'Web') AS mean_value
    FROM page_flow WHERE loading_time BETWEEN 200 AND 900 AND os_type = 'Web' ORDER BY page_start_tm DESC, device_id LIMIT 1000
    """,
)
def _(t: Tables):
    cond = F.col("loading_time").between(200, 900) & (F.col("os_type") == "Web")
    return perf.list_with_mean(t.pages, "page_start_tm", "loading_time", 1000, cond).select("page_id", "page_start_tm", "loading_time", "mean_value")


@query(
    "speed_classes",
    """
    SELECT page_name, speed_class, count(*) AS cnt FROM (
      SELECT page_name, CASE WHEN s IS NULL OR loading_time IS NULL THEN 4 WHEN loading_time <= s * 0.6 THEN 0 WHEN loading_time <= s * 0.8 THEN 1 WHEN loading_time <= s THEN 2
        WHEN loading_time <= s * 1.2 THEN 3 ELSE 4 END AS speed_class
      FROM page_flow LEFT JOIN (VALUES ('https://app/p1', 1000), ('https://app/p2', 700)) v(page_name, s) USING (page_name)) GROUP BY 1, 2
    """,
)
def _(t: Tables):
    standards = literal_frame(t.spark, [("https://app/p1", 1000), ("https://app/p2", 700)], ["url", "standard_ms"])
    classed = perf.speed_classes(t.pages, standards, "loading_time")
    return classed.groupBy("page_name", "speed_class").agg(F.count(F.lit(1)).alias("cnt"))


@query("over_limit", f"SELECT page_id, loading_time FROM page_flow WHERE log_date = DATE '{_D}' AND loading_time > 1000")
def _(t: Tables):
    return perf.over_limit(t.pages, "loading_time", 1000, _D).select("page_id", "loading_time")


@query("viewer_chart", _filled("page_flow", "page_start_tm", 5 * tg.MINUTE, DAY, DAY + tg.DAY, "count(DISTINCT device_id) AS u, count(*) AS n", "coalesce(u, 0) AS viewers, coalesce(n, 0) AS views"))
def _(t: Tables):
    return perf.viewer_chart(t.pages, DAY, DAY + tg.DAY)
