"""Pages, sessions, flows and user lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.operators import session
from tidemark.plans.registry import Tables, query

# The driver's events are sparse, so sessions use a 12-hour gap here.
GAP = 12 * tg.HOUR
START, END = tg.millis(dt.date(2024, 1, 8)), tg.millis(dt.date(2024, 1, 22))

FLOW_CTES = f"""
flow_lag AS (
  SELECT *, lag(page_start_tm) OVER w AS prev_tm, coalesce(lag(req_url) OVER w, '') AS pre_url, coalesce(lag(page_end_tm) OVER w, 0) AS pre_url_time
  FROM page_flow WINDOW w AS (PARTITION BY device_id ORDER BY page_start_tm, page_id)),
flow_no AS (
  SELECT *, sum(CASE WHEN prev_tm IS NULL OR page_start_tm - prev_tm > {GAP} OR log_type = 1048597 THEN 1 ELSE 0 END)
    OVER (PARTITION BY device_id ORDER BY page_start_tm, page_id) AS session_no FROM flow_lag),
flow AS (
  SELECT * EXCLUDE (prev_tm, session_no), min(page_start_tm) OVER (PARTITION BY device_id, session_no) AS parent_log_date,
    row_number() OVER (PARTITION BY device_id, session_no ORDER BY page_start_tm, page_id) AS flow_order,
    split_part(pre_url, '?', 1) AS pre_page FROM flow_no)
"""


def flow(t: Tables):
    return session.sessionize(t.pages, GAP).withColumn("pre_page", F.substring_index("pre_url", "?", 1))


OPENERS = (lt.APP_FIRST_START, lt.WEB_START)


@query(
    "build_pages",
    """
    SELECT device_id, page_no, max(req_url) FILTER (log_type IN (1048597, 131073)) AS req_url,
           max(log_type) FILTER (log_type IN (1048597, 131073)) AS log_type, max(log_tm) FILTER (log_type IN (1048597, 131073)) AS page_start_tm,
           max(log_tm) AS page_end_tm, max(log_tm) - max(log_tm) FILTER (log_type IN (1048597, 131073)) AS intervaltime, count(*) AS log_count,
           count(*) FILTER (log_type = 131077) AS error_count, count(*) FILTER (log_type = 131077) AS js_error_count,
           count(*) FILTER (log_type = 2097152) AS crash_count, 'N' AS wtf_flag
    FROM (SELECT *, CAST(sum(CASE WHEN log_type IN (1048597, 131073) THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY log_tm, event_id) AS BIGINT) AS page_no FROM event_log)
    WHERE page_no > 0 GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return session.build_pages(t.events).select(
        "device_id", "page_no", "req_url", "log_type", "page_start_tm", "page_end_tm", "intervaltime", "log_count",
        "error_count", "js_error_count", "crash_count", "wtf_flag",
    )


@query(
    "with_flow",
    """
    SELECT device_id, page_id, row_number() OVER w AS flow_order, coalesce(lag(req_url) OVER w, '') AS pre_url,
           coalesce(lag(page_end_tm) OVER w, 0) AS pre_url_time,
           coalesce(last_value(CASE WHEN log_type = 1048597 THEN page_start_tm END IGNORE NULLS) OVER w, first_value(page_start_tm) OVER w) AS parent_log_date
    FROM page_flow WINDOW w AS (PARTITION BY device_id ORDER BY page_start_tm, page_id)
    """,
)
def _(t: Tables):
    flowed = session.with_flow(t.pages, ["page_start_tm", "page_id"], app_start=lt.APP_FIRST_START)
    return flowed.select("device_id", "page_id", "flow_order", "pre_url", "pre_url_time", "parent_log_date")


@query(
    "sessionize",
    "SELECT device_id, page_id, parent_log_date, flow_order, pre_url, pre_url_time FROM flow",
    ctes=FLOW_CTES,
)
def _(t: Tables):
    return flow(t).select("device_id", "page_id", "parent_log_date", "flow_order", "pre_url", "pre_url_time")


@query(
    "event_timeline",
    f"""
    SELECT device_id, event_id, log_tm, log_type, req_url AS alias FROM event_log WHERE log_tm >= {START} AND log_tm < {END}
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY log_tm, event_id) <= 20
    """,
)
def _(t: Tables):
    return session.event_timeline(t.events, START, END, 20).select("device_id", "event_id", "log_tm", "log_type", "alias")


@query(
    "session_pages",
    """
    SELECT device_id, page_id, parent_log_date, flow_order FROM flow
    QUALIFY dense_rank() OVER (PARTITION BY device_id ORDER BY parent_log_date DESC) BETWEEN 3 AND 12
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    return session.session_pages(flow(t), 10, 2).select("device_id", "page_id", "parent_log_date", "flow_order")


@query(
    "page_flow",
    """
    SELECT device_id, page_id, parent_log_date, flow_order, min(page_start_tm) OVER w AS session_start, max(page_end_tm) OVER w AS session_end,
           count(*) OVER w AS session_pages FROM flow WHERE os_type = 'Web' OR device_model = 'M3' WINDOW w AS (PARTITION BY device_id, parent_log_date)
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    rows = session.page_flow(flow(t), {"os_type": "Web", "device_model": "M3"})
    return rows.select("device_id", "page_id", "parent_log_date", "flow_order", "session_start", "session_end", "session_pages")


@query(
    "session_at",
    """
    SELECT e.device_id, e.log_tm + 500 AS at_ms, f.page_id, f.parent_log_date FROM event_log e
    JOIN flow f ON e.device_id = f.device_id AND f.page_start_tm <= e.log_tm + 500 AND f.page_end_tm >= e.log_tm + 500
    WHERE e.log_type IN (131077, 2097152)
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    points = t.trouble.select("device_id", (F.col("log_tm") + 500).alias("at_ms"))
    return session.session_at(flow(t), points).select("device_id", "at_ms", "page_id", "parent_log_date")


@query(
    "active_user_list",
    f"""
    SELECT device_id, arg_max(package_nm, (page_start_tm, page_id)) AS package_nm, arg_max(os_type, (page_start_tm, page_id)) AS os_type,
           arg_max(device_model, (page_start_tm, page_id)) AS device_model, max(page_start_tm) AS last_seen,
           CAST(coalesce(sum(intervaltime), 0) AS BIGINT) AS intervaltime, CAST(sum(request_count) AS BIGINT) AS request_count,
           CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(crash_count) AS BIGINT) AS crash_count, count(DISTINCT parent_log_date) AS sessions
    FROM flow WHERE page_start_tm >= {START} AND page_start_tm < {END} GROUP BY 1 ORDER BY last_seen DESC, device_id LIMIT 50
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    return session.active_user_list(flow(t), START, END, 50)


@query(
    "user_list",
    """
    SELECT device_id, user_id, package_nm, os_type, device_model, app_ver, req_url, page_start_tm AS last_time FROM page_flow
    WHERE starts_with(device_id, 'd1') OR starts_with(user_id, 'u3')
    QUALIFY row_number() OVER (PARTITION BY device_id, user_id ORDER BY page_start_tm DESC, page_id DESC) = 1
    ORDER BY last_time DESC, device_id, user_id LIMIT 100
    """,
)
def _(t: Tables):
    return session.user_list(t.pages, 100, {"device_id": "d1", "user_id": "u3"}, prefix=True)


@query(
    "total_users",
    """
    SELECT device_id, latest_session, intervaltime, users FROM
      (SELECT device_id, max(parent_log_date) AS latest_session, CAST(coalesce(sum(intervaltime), 0) AS BIGINT) AS intervaltime
       FROM flow GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
    LEFT JOIN (SELECT device_id, string_agg(user_id, '|' ORDER BY seen DESC, user_id) AS users
               FROM (SELECT device_id, user_id, max(page_start_tm) AS seen FROM flow WHERE user_id IS NOT NULL GROUP BY 1, 2
                     QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY seen DESC, user_id) <= 50) GROUP BY 1) USING (device_id)
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    return session.total_users(flow(t), 100, 50)


@query(
    "user_detail",
    """
    SELECT device_id, p.user_id, p.app_ver, p.device_model, p.req_url, p.page_start_tm AS last_page,
           CAST(a.last_access AS VARCHAR) AS last_access, a.access_count, CAST(i.created_date AS VARCHAR) AS created_date, i.active_st, i.vip_yn
    FROM (SELECT * FROM page_flow QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY page_start_tm DESC, page_id DESC) = 1) p
    LEFT JOIN (SELECT device_id, max(log_date) AS last_access, CAST(sum(visit_cnt) AS BIGINT) AS access_count FROM access_history GROUP BY 1) a USING (device_id)
    LEFT JOIN device_info i USING (device_id)
    """,
)
def _(t: Tables):
    return session.user_detail(t.pages, t.access, t.devices)


@query(
    "log_context",
    """
    SELECT device_id, a.log_tm AS anchor_ms, e.pos - a.pos AS "offset", e.event_id FROM ranked a JOIN ranked e USING (device_id)
    WHERE a.log_type = 2097152 AND e.pos - a.pos BETWEEN -10 AND 10
    """,
    ctes="ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY log_tm, event_id) AS pos FROM event_log)",
)
def _(t: Tables):
    anchors = t.events.filter(F.col("log_type") == lt.CRASH).select("device_id", F.col("log_tm").alias("anchor_ms"))
    return session.log_context(t.events, anchors).select("device_id", "anchor_ms", "offset", "event_id")


@query(
    "log_context_range",
    f"""
    SELECT device_id, a.log_tm AS anchor_ms, e.pos - a.pos AS "offset", e.event_id FROM ranked a JOIN ranked e USING (device_id)
    WHERE a.log_type = 2097152 AND e.pos - a.pos BETWEEN -10 AND 10 AND abs(e.log_tm - a.log_tm) < {6 * tg.HOUR}
    """,
    ctes="ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY log_tm, event_id) AS pos FROM event_log)",
)
def _(t: Tables):
    anchors = t.events.filter(F.col("log_type") == lt.CRASH).select("device_id", F.col("log_tm").alias("anchor_ms"))
    return session.log_context(t.events, anchors, range_ms=6 * tg.HOUR).select("device_id", "anchor_ms", "offset", "event_id")


@query(
    "page_relations",
    """
    SELECT page, direction, CASE WHEN other = '' THEN '-' ELSE other END AS other, cnt, is_other, total FROM (
      SELECT page, direction, other, cnt, 0 AS is_other, total FROM ranked WHERE rn <= 3 OR (direction = 'OUT' AND other = 'https://app/p5')
      UNION ALL SELECT page, direction, 'Others', CAST(sum(cnt) AS BIGINT), 1, max(total) FROM ranked WHERE rn > 3 GROUP BY 1, 2)
    """,
    ctes=FLOW_CTES + """,
moves AS (
  SELECT page_name AS page, 'IN' AS direction, pre_page AS other FROM flow WHERE page_name <> pre_page
  UNION ALL SELECT pre_page, 'OUT', page_name FROM flow WHERE page_name <> pre_page AND pre_page <> ''),
counts AS (SELECT page, direction, other, count(*) AS cnt FROM moves GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page, direction ORDER BY cnt DESC, other) AS rn,
  CAST(sum(cnt) OVER (PARTITION BY page, direction) AS BIGINT) AS total FROM counts)
""",
)
def _(t: Tables):
    return session.page_relations(flow(t), target="https://app/p5", n=3)


_FROM = ("https://app/p1", "https://app/p2", "https://app/p3")
_FROM_SQL = ", ".join(f"'{u}'" for u in _FROM)
_HITS = f"""
hits AS (SELECT *, CASE WHEN pre_url_time <> 0 THEN page_start_tm - pre_url_time ELSE 0 END AS lead_ms FROM flow WHERE pre_page IN ({_FROM_SQL})),
hourly AS (
  SELECT date_trunc('hour', page_start_tm_dt) AS bucket, package_nm, server_type, count(DISTINCT device_id) AS users,
         count(*) FILTER (page_name = 'https://app/p5') AS reach, count(*) FILTER (page_name <> 'https://app/p5') AS bounce
  FROM hits WHERE page_start_tm BETWEEN {START} AND {END} GROUP BY ALL)
"""


@query(
    "reach_bounce_hourly",
    "SELECT CAST(bucket AS VARCHAR) AS bucket, package_nm, server_type, users, reach, bounce FROM hourly",
    ctes=FLOW_CTES + "," + _HITS,
)
def _(t: Tables):
    return session.reach_bounce(flow(t), _FROM, "https://app/p5", START, END)


@query(
    "reach_bounce_daily",
    f"""
    SELECT *, floor(reach / (reach + bounce) * 1000 + 0.5) / 10 AS reach_rate, floor(bounce / (reach + bounce) * 1000 + 0.5) / 10 AS bounce_rate FROM (
      SELECT CAST(CAST(page_start_tm_dt + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS bucket, package_nm, server_type, count(DISTINCT device_id) AS users,
             count(*) FILTER (page_name = 'https://app/p5') AS reach, count(*) FILTER (page_name <> 'https://app/p5') AS bounce, round(avg(lead_ms), 6) AS lead
      FROM hits WHERE page_start_tm BETWEEN {START} AND {END} GROUP BY ALL)
    """,
    ctes=FLOW_CTES + "," + _HITS,
)
def _(t: Tables):
    daily = session.reach_bounce(flow(t), _FROM, "https://app/p5", START, END, grain="day", tz="Asia/Seoul")
    return session.reach_bounce_rate(daily)


@query(
    "interpolate_hours",
    """
    SELECT g.package_nm, g.server_type, CAST(g.b AS VARCHAR) AS bucket,
      CAST(coalesce(h.users, floor(lu + (nu - lu) * r + 0.5)) AS BIGINT) AS users, CAST(coalesce(h.reach, floor(lr + (nr - lr) * r + 0.5)) AS BIGINT) AS reach
    FROM (SELECT g.*, p.users AS lu, p.reach AS lr, n.users AS nu, n.reach AS nr, CASE WHEN n.bucket > p.bucket THEN epoch(g.b - p.bucket) / epoch(n.bucket - p.bucket) END AS r
          FROM (SELECT package_nm, server_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS b FROM hourly GROUP BY 1, 2) g
          ASOF JOIN hourly p ON p.package_nm = g.package_nm AND g.b >= p.bucket
          ASOF JOIN hourly n ON n.package_nm = g.package_nm AND g.b <= n.bucket) g
    LEFT JOIN hourly h ON h.package_nm = g.package_nm AND h.bucket = g.b
    """,
    ctes=FLOW_CTES + "," + _HITS,
)
def _(t: Tables):
    hourly = session.reach_bounce(flow(t), _FROM, "https://app/p5", START, END)
    return session.interpolate_hours(hourly, ["users", "reach"])


@query(
    "reach_bounce_rows",
    """
    SELECT page_start_tm, device_id, pre_page, page_name, CASE WHEN pre_url_time <> 0 THEN CAST(lead_ms AS VARCHAR) ELSE '-' END AS lead,
           (SELECT count(*) FROM hits WHERE page_name <> 'https://app/p5') AS total, (SELECT round(avg(lead_ms), 6) FROM hits WHERE page_name <> 'https://app/p5') AS lead_avg
    FROM hits WHERE page_name <> 'https://app/p5' AND (page_start_tm < 1706000000000) ORDER BY page_start_tm DESC, device_id DESC LIMIT 50
    """,
    ctes=FLOW_CTES + "," + _HITS,
)
def _(t: Tables):
    rows = session.reach_bounce_rows(flow(t), _FROM, "https://app/p5", "bounce", after=(1706000000000, ""))
    return rows.select("page_start_tm", "device_id", "pre_page", "page_name", "lead", "total", "lead_avg")


@query(
    "flow_summary",
    """
    SELECT package_nm, flow_order, page_name AS page, next_page, count(*) AS req_count, CAST(sum(crash_count) AS BIGINT) AS crash_count,
           CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(intervaltime) AS BIGINT) AS sum_intervaltime, min(intervaltime) AS min_intervaltime,
           max(intervaltime) AS max_intervaltime, count(*) FILTER (next_page IS NULL) AS node_end_req_count,
           CAST(coalesce(sum(crash_count) FILTER (next_page IS NULL), 0) AS BIGINT) AS node_end_crash_count,
           CAST(coalesce(sum(error_count) FILTER (next_page IS NULL), 0) AS BIGINT) AS node_end_error_count,
           CAST(sum(intervaltime) FILTER (next_page IS NULL) AS BIGINT) AS node_end_sum_intervaltime,
           min(intervaltime) FILTER (next_page IS NULL) AS node_end_min_intervaltime, max(intervaltime) FILTER (next_page IS NULL) AS node_end_max_intervaltime,
           round(avg(response_time), 6) AS avg_response_time, round(avg(loading_time), 6) AS avg_loading_time,
           round(avg(sum_cpu_usage), 6) AS avg_cpu_usage, round(avg(sum_mem_usage), 6) AS avg_mem_usage
    FROM (SELECT *, lead(page_name) OVER (PARTITION BY device_id, parent_log_date ORDER BY page_start_tm, page_id) AS next_page FROM flow)
    GROUP BY 1, 2, 3, 4
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    return session.flow_summary(session.sessionize(t.pages, GAP, with_next=True))


@query("next_page", "SELECT page_id, lead(req_url) OVER (PARTITION BY device_id, parent_log_date ORDER BY page_start_tm, page_id) AS next_url FROM flow", ctes=FLOW_CTES)
def _(t: Tables):
    return session.sessionize(t.pages, GAP, with_next=True).select("page_id", "next_url")


def session_log(t: Tables):
    """Events with a session id: device and day."""
    return t.events.withColumn("session_id", F.concat_ws("_", "device_id", F.col("log_date").cast("string")))


@query(
    "session_bounds",
    """
    SELECT device_id || '_' || log_date AS session_id, coalesce(min(log_tm) FILTER (log_type = 1048597), min(log_tm)) AS start_tm, max(log_tm) AS end_tm
    FROM event_log GROUP BY 1
    """,
)
def _(t: Tables):
    pages = t.pages.withColumn("session_id", F.concat_ws("_", "device_id", F.col("log_date").cast("string")))
    return session.session_bounds(pages, session_log(t), app_start=lt.APP_FIRST_START)


@query(
    "replay_actions",
    """
    SELECT e.device_id, e.log_tm, e.log_type, CASE WHEN e.log_type = 131073 THEN p.loading_time END AS loading_time
    FROM event_log e LEFT JOIN page_flow p ON p.device_id = e.device_id AND p.page_start_tm = e.log_tm
    WHERE e.log_type IN (131073, 131088, 131077)
    """,
)
def _(t: Tables):
    return session.replay_actions(session_log(t), t.pages).select("device_id", "log_tm", "log_type", "loading_time")


_LAST = """
last_session AS (SELECT device_id, max(parent_log_date) AS session_start FROM flow GROUP BY 1)
"""


@query(
    "session_detail_profile",
    """
    SELECT device_id, max(parent_log_date) AS session_start, arg_max(user_id, page_start_tm) AS user_id, arg_max(os_type, page_start_tm) AS os_type,
           arg_max(app_ver, page_start_tm) AS app_ver, arg_max(device_model, page_start_tm) AS device_model FROM flow GROUP BY 1
    """,
    ctes=FLOW_CTES,
)
def _(t: Tables):
    return session.session_detail(flow(t), t.vitals, t.events, 100)["profile"]


@query(
    "session_detail_vitals",
    """
    SELECT device_id, round(avg(value) FILTER (name = 'lcp'), 8) AS lcp, round(avg(value) FILTER (name = 'inp'), 8) AS inp, round(avg(value) FILTER (name = 'cls'), 8) AS cls
    FROM vital_log JOIN last_session USING (device_id) WHERE log_tm >= session_start GROUP BY 1
    """,
    ctes=FLOW_CTES + "," + _LAST,
)
def _(t: Tables):
    return session.session_detail(flow(t), t.vitals, t.events, 100)["vitals"]


@query(
    "session_detail_pages",
    """
    SELECT device_id, page_id, page_start_tm FROM flow JOIN last_session USING (device_id) WHERE page_start_tm >= session_start
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY page_start_tm DESC, page_id DESC) <= 100
    """,
    ctes=FLOW_CTES + "," + _LAST,
)
def _(t: Tables):
    return session.session_detail(flow(t), t.vitals, t.events, 100)["pages"].select("device_id", "page_id", "page_start_tm")


@query(
    "session_detail_events",
    """
    SELECT device_id, event_id, log_tm FROM event_log JOIN last_session USING (device_id) WHERE log_tm >= session_start AND log_type IN (131073, 131088, 131077)
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY log_tm DESC, event_id DESC) <= 100
    """,
    ctes=FLOW_CTES + "," + _LAST,
)
def _(t: Tables):
    return session.session_detail(flow(t), t.vitals, t.events, 100)["events"].select("device_id", "event_id", "log_tm")


@query("page_events", "SELECT event_id, event_id AS page_id, log_type FROM event_log WHERE event_id IN (SELECT page_id FROM page_flow WHERE crash_count > 0)")
def _(t: Tables):
    events = t.events.withColumn("page_id", F.col("event_id"))
    return session.page_events(events, t.pages.filter("crash_count > 0")).select("event_id", "page_id", "log_type")
