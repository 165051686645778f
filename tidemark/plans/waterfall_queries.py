"""Waterfalls, stack frames and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions import timegrid as tg
from tidemark.operators import textjobs, waterfall
from tidemark.plans.registry import Tables, query


def entries(t: Tables):
    return waterfall.read_entries(t.perf)


_RESOURCE = "'duration|entryType|initiatorType|name|responseStatus|startTime|transferSize'"


@query(
    "expand_perf_keys",
    f"""
    SELECT event_id AS page_id, 1 AS seq, 'connectEnd|connectStart|domComplete|domContentLoadedEventEnd|domInteractive|domainLookupEnd|domainLookupStart|duration|entryType|fetchStart|loadEventEnd|name|redirectEnd|redirectStart|requestStart|responseEnd|responseStart|responseStatus|secureConnectionStart|startTime|transferSize' AS names,
           req_url AS name, NULL AS sources FROM event_log
    UNION ALL SELECT event_id, 2, {_RESOURCE}, 'https://cdn.app/img' || (k % 7) || '.png', NULL FROM event_log
    UNION ALL SELECT event_id, 3, {_RESOURCE}, 'https://js.app/s.js', NULL FROM event_log
    UNION ALL SELECT event_id, 4, 'entryType|size|sources|startTime|url', '', '[{{"startTime":1}}]' FROM event_log
    UNION ALL SELECT event_id, 5, 'duration|entryType|name|startTime', 'self', NULL FROM event_log
    UNION ALL SELECT event_id, 6, 'duration|entryType|name|startTime', 'click', NULL FROM event_log
    UNION ALL SELECT event_id, 7, 'duration|entryType|name|startTime', 'click', NULL FROM event_log
    UNION ALL SELECT event_id, 8, {_RESOURCE}, '//cdn.b/y.js', NULL FROM event_log
    """,
)
def _(t: Tables):
    rows = waterfall.expand_perf_keys(t.perf)
    names = F.array_join(F.array_sort(F.map_keys("entry")), "|")
    return rows.select(
        "page_id", F.col("seq").cast("long").alias("seq"), names.alias("names"),
        F.coalesce(F.col("entry")["name"], F.lit("")).alias("name"), F.col("entry")["sources"].alias("sources"),
    )


_NAV = """
nav AS (SELECT event_id AS page_id, device_id, req_url AS url, k * 1000 AS transfer_size, status_code AS status, 1.0 AS t0, 10.0 + k % 5 AS rq, k % 3 + 0.0 AS d0, k % 3 + 2.0 AS d1, 4.0 AS c0,
  9.0 + k % 4 AS c1, 20.0 + k AS r0, 30.0 + k AS r1, 50.0 + k AS dcl, 80.0 + k AS ld, k FROM event_log),
phases AS (SELECT page_id, device_id, url, transfer_size, status, i AS phase_no, n AS name, CAST(a AS DOUBLE) AS start_time, CAST(b AS DOUBLE) AS response_end FROM nav,
  LATERAL (VALUES (0, 'Waiting', t0, rq), (1, 'DNS Lookup', d0, d1), (2, 'TCP Connect Start', c0, c1), (3, 'Request Time', rq, r0),
           (4, 'Response Time', r0, r1), (5, 'Dom Processing', r1, dcl), (6, 'Dom Load', dcl, ld)) v(i, n, a, b) WHERE b >= a AND a > 0)
"""


@query("nav_phases", "SELECT page_id, name, url, start_time, response_end, response_end - start_time AS duration, CAST(transfer_size AS BIGINT) AS transfer_size, status FROM phases", ctes=_NAV)
def _(t: Tables):
    return waterfall.nav_phases(entries(t)).select("page_id", "name", "url", "start_time", "response_end", "duration", "transfer_size", "status")


_ROWS = _NAV + """,
others AS (
  SELECT event_id AS page_id, 2 AS seq, 'https://cdn.app/img' || (k % 7) || '.png' AS name, 'resource' AS entry_type, 'img' AS kind, 'cdn.app' AS domain, CAST(40 + k % 10 AS DOUBLE) AS start_time, 15.5 AS duration,
         CAST(200 AS BIGINT) AS status, k * 30000 AS size, CASE WHEN k > 0 THEN 'lcp' END AS mark FROM event_log
  UNION ALL SELECT event_id, 3, 'https://js.app/s.js', 'resource', 'script', 'js.app', 35, 20, 200, 512, NULL FROM event_log
  UNION ALL SELECT event_id, 4, 'https://cdn.app/img' || (k % 7) || '.png', 'largest-contentful-paint', 'largest-contentful-paint', 'cdn.app', 45, 0, 0, 0, NULL FROM event_log
  UNION ALL SELECT event_id, 5, 'self', 'longtask', 'longtask', '', 60, 50 + k % 40, 0, 0, NULL FROM event_log
  UNION ALL SELECT event_id, 6, 'click', 'first-input', 'first-input', '', k % 4, 8, 0, 0, NULL FROM event_log
  UNION ALL SELECT event_id, 7, 'click', 'event', 'event', '', 90, 16, 0, 0, NULL FROM event_log
  UNION ALL SELECT event_id, 8, '//cdn.b/y.js', 'resource', 'other', 'cdn.b', 70, 5, 200, 100, NULL FROM event_log),
all_rows AS (
  SELECT page_id, 0 AS o, phase_no AS seq, name, 'reformNavigation' AS entry_type, 'reformnavigation' AS kind, '' AS domain, start_time, response_end - start_time AS duration, status, transfer_size AS size, NULL AS mark FROM phases
  UNION ALL SELECT page_id, 1, seq, name, entry_type, kind, domain, start_time, duration, status, size, mark FROM others)
"""


@query(
    "waterfall_rows",
    """
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o, start_time, seq) AS position, name, entry_type, kind, domain, CAST(start_time AS DOUBLE) AS start_time,
           CAST(duration AS DOUBLE) AS duration, status, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.1f} KB', size / 1024) ELSE format('{:.1f} MB', size / 1048576) END AS size_label,
           format('{:.1f}ms ~ {:.1f}ms', CAST(start_time AS DOUBLE), CAST(start_time + greatest(duration, 0) AS DOUBLE)) AS time_label, mark FROM all_rows
    """,
    ctes=_ROWS,
)
def _(t: Tables):
    return waterfall.waterfall_rows(entries(t)).drop("device_id")


@query(
    "mark_lcp",
    "SELECT event_id AS page_id, 2 AS seq, 'https://cdn.app/img' || (k % 7) || '.png' AS lcp_url, CAST(k * 10 AS BIGINT) AS lcp_size FROM event_log WHERE k > 0",
)
def _(t: Tables):
    return waterfall.mark_lcp(entries(t)).select("page_id", F.col("seq").cast("long").alias("seq"), "lcp_url", "lcp_size")


@query(
    "timing_summary",
    """
    SELECT event_id AS page_id, CAST(nullif(k % 4, 0) AS DOUBLE) AS fid, CAST(nullif(k % 40, 0) AS DOUBLE) AS tbt, CAST(49 + k AS DOUBLE) AS dcl_time, CAST(79 + k AS DOUBLE) AS load_time,
           30.0::DOUBLE AS dom_processing_time, CAST(5 + k % 4 + CASE WHEN k % 2 = 0 THEN 3 + k % 4 ELSE 0 END AS DOUBLE) AS connection_time, 2.0::DOUBLE AS dns_lookup_time,
           CAST(nullif(k % 6, 0) AS DOUBLE) AS redirect_time, CAST(28 + k AS DOUBLE) AS fetch_time, CAST(45 + k AS DOUBLE) AS dom_interactive,
           nullif(p.fcp, 0) AS fcp, nullif(p.lcp, 0) AS lcp, nullif(p.inp, 0) AS inp, nullif(p.cls, 0) AS cls, nullif(p.ttfb, 0) AS ttfb
    FROM event_log JOIN page_flow p ON p.page_id = event_id
    """,
)
def _(t: Tables):
    # Each vital is sent again a moment later with 0, which tells nothing.
    again = t.vitals.withColumns({"log_tm": F.col("log_tm") + 1, "value": F.lit(0.0)})
    return waterfall.timing_summary(entries(t), t.vitals.unionByName(again)).drop("device_id")


@query(
    "perf_lanes",
    """
    SELECT page_id, lane, label, CAST(start AS DOUBLE) AS start, CAST(duration AS DOUBLE) AS duration FROM (
      SELECT page_id, CASE entry_type WHEN 'resource' THEN 'resource' WHEN 'longtask' THEN 'long_task' WHEN 'event' THEN 'click' END AS lane, name AS label, start_time AS start, duration
      FROM others UNION ALL SELECT event_id, 'error', log_name, 0, 0 FROM trouble_log) WHERE lane IS NOT NULL
    """,
    ctes=_ROWS,
)
def _(t: Tables):
    errors = t.trouble.withColumn("page_id", F.col("event_id"))
    return waterfall.perf_lanes(entries(t), errors, t.pages).drop("device_id")


def traces(t: Tables):
    """Trouble rows with a console trace made from their values."""
    trace = F.expr(
        r"""concat('Uncaught Error: e', k, '\r\n    at B (page-', k % 5, '.js:1:', 8000 + k, ')\n  at https://cdn.app/lib', k % 3, '.js:2:', 10 * k,
            '\nObject.run (https://m.app:8080/dir/f.js:3:77)\n at <anonymous>:1:16\nno frame here\n at x.js:9')"""
    )
    return t.trouble.select("event_id", "device_id", trace.alias("res_msg"))


_FRAMES = """
frames AS (
  SELECT event_id, device_id, i AS line_no, f AS file, l AS line, c AS "column" FROM trouble_log, LATERAL (VALUES
    (1, 'page-' || (k % 5) || '.js', 1, 8000 + k), (2, 'https://cdn.app/lib' || (k % 3) || '.js', 2, 10 * k), (3, 'https://m.app:8080/dir/f.js', 3, 77), (6, 'x.js', 9, 1)) v(i, f, l, c))
"""


@query("stack_frames", 'SELECT event_id, line_no, file, line, "column" FROM frames', ctes=_FRAMES)
def _(t: Tables):
    return textjobs.stack_frames(traces(t)).drop("device_id")


@query("crash_groups", 'SELECT file, line, "column", count(*) AS cnt, count(DISTINCT device_id) AS devices FROM frames WHERE line_no = 1 GROUP BY 1, 2, 3', ctes=_FRAMES)
def _(t: Tables):
    return textjobs.crash_groups(textjobs.stack_frames(traces(t)))


@query(
    "map_frames",
    """
    SELECT event_id, f.file, f.line, f."column", m.source, m.source_line, m.source_column FROM frames f ASOF LEFT JOIN mapping m
      ON f.file = m.file AND f.line = m.line AND f."column" >= m.g
    """,
    ctes=_FRAMES + """,
mapping AS (
  SELECT DISTINCT 'page-' || (k % 5) || '.js' AS file, 1 AS line, 8000 + k // 10 * 10 AS g, 'src' || (k // 10) || '.ts' AS source, CAST(k // 10 AS BIGINT) AS source_line, CAST(3 AS BIGINT) AS source_column FROM event_log)
""",
)
def _(t: Tables):
    mapping = t.events.selectExpr(
        "concat('page-', k % 5, '.js') AS file", "1L AS line", "CAST(8000 + k div 10 * 10 AS BIGINT) AS generated_column",
        "concat('src', k div 10, '.ts') AS source", "CAST(k div 10 AS BIGINT) AS source_line", "3L AS source_column",
    ).distinct()
    return textjobs.map_frames(textjobs.stack_frames(traces(t)), mapping).drop("device_id", "line_no")


@query(
    "location_name",
    """
    SELECT location_code, CASE location_code WHEN 'kr-so' THEN 'Seoul Special City' WHEN 'kr-pu' THEN 'Busan Metropolitan City' WHEN 'kr-cj' THEN 'Jeju Special Self-Governing Province' ELSE location_code END AS location_name,
           location_code AS again, count(*) AS cnt
    FROM (SELECT CASE k % 4 WHEN 0 THEN 'kr-so' WHEN 1 THEN 'kr-pu' WHEN 2 THEN 'kr-cj' ELSE 'XX' END AS location_code FROM event_log) GROUP BY 1, 2, 3
    """,
)
def _(t: Tables):
    code = F.expr("CASE k % 4 WHEN 0 THEN 'kr-so' WHEN 1 THEN 'kr-pu' WHEN 2 THEN 'kr-cj' ELSE 'XX' END")
    named = t.events.withColumn("location_code", code).withColumn("location_name", textjobs.location_name("location_code", "en"))
    again = textjobs.location_code("location_name", "en").alias("again")
    return named.groupBy("location_code", "location_name", again).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "mask_user",
    """
    SELECT coalesce(user_id, '') AS user_id, CASE WHEN user_id IS NULL THEN '-' WHEN length(user_id) <= 2 THEN user_id ELSE substr(user_id, 1, 2) || repeat('*', length(user_id) - 2) END AS masked
    FROM event_log GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return t.events.select(F.coalesce("user_id", F.lit("")).alias("user_id"), text.mask_user("user_id", 2).alias("masked")).distinct()


@query(
    "format_units",
    """
    SELECT event_id, CASE WHEN k = 0 THEN '0MB' ELSE format('{:.1f}MB', round(k * 1000 / 1024, 1)) END AS mem_kb, CASE WHEN k = 0 THEN '0MB' ELSE format('{:.1f}GB', round(k / 1024, 1)) END AS mem_mb,
           format('{:.1f}MB', (k * 1000 + 0.5) / 1024) AS mem_decimal, CASE WHEN k % 2 = 0 THEN '0GB' ELSE '0MB' END AS mem_odd,
           CASE WHEN intervaltime < 1000 THEN intervaltime || 'ms' WHEN intervaltime < 60000 THEN (intervaltime // 1000) || 's' ELSE (intervaltime // 60000) || 'm ' || (intervaltime % 60000 // 1000) || 's' END AS stay
    FROM event_log
    """,
)
def _(t: Tables):
    return t.events.select(
        "event_id", text.fmt_mem(F.col("k") * 1000, "kb").alias("mem_kb"), text.fmt_mem("k", "mb").alias("mem_mb"),
        text.fmt_mem(F.concat(F.col("k") * 1000, F.lit(".5")), "kb").alias("mem_decimal"), text.fmt_mem(F.when(F.col("k") % 2 == 0, "many"), "kb").alias("mem_odd"),
        text.fmt_ms("intervaltime").alias("stay"),
    )


@query(
    "calendar_days",
    f"""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS log_date, coalesce(n, 0) AS cnt FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) g(d)
    LEFT JOIN (SELECT log_date, count(*) AS n FROM event_log GROUP BY 1) ON log_date = CAST(d AS DATE)
    """,
)
def _(t: Tables):
    days = tg.calendar(t.spark, dt.date(2023, 12, 25), dt.date(2024, 2, 5), "day", "log_date")
    counts = t.events.groupBy("log_date").agg(F.count(F.lit(1)).alias("cnt"))
    return days.join(counts, "log_date", "left").fillna(0, ["cnt"])


@query(
    "shipping_calendar",
    """
    SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS month, coalesce(n, 0) AS cnt FROM generate_series((SELECT date_trunc('month', min(l_shipdate)) FROM lineitem), TIMESTAMP '2002-12-01', INTERVAL 1 MONTH) g(m)
    LEFT JOIN (SELECT date_trunc('month', l_shipdate) AS b, count(*) AS n FROM lineitem GROUP BY 1) ON b = m
    """,
)
def _(t: Tables):
    counts = t.raw("lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("cnt"))
    months = counts.agg(F.min("month").alias("lo")).select(
        F.explode(F.sequence(F.col("lo"), F.lit(dt.date(2002, 12, 1)), F.expr("INTERVAL 1 MONTH"))).alias("month")
    )
    return months.join(counts, "month", "left").fillna(0, ["cnt"])


