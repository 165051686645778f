"""Versions, devices and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import timegrid as tg
from tidemark.operators import devices, versions
from tidemark.plans.registry import Tables, query
from tidemark.sources import driver_tables as dtb

_D = dtb.AS_OF
_FROM, _TO = dt.date(2024, 1, 10), dt.date(2024, 1, 25)
_RANGE = f"BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"
_PAIRS = [("Android", "1.0"), ("iOS", "1.3"), ("Web", "9.9")]


@query(
    "version_compare",
    """
    SELECT a.os_type, a.app_ver, coalesce(cpu, 0) AS sum_cpu_usage, coalesce(mem, 0) AS sum_mem_usage, coalesce(n, 0) AS log_count, coalesce(e, 0) AS error_count,
           coalesce(c, 0) AS crash_count, coalesce(l, 0) AS loading_time, coalesce(r, 0) AS response_time, coalesce(u, 0) AS users
    FROM (VALUES ('Android', '1.0'), ('iOS', '1.3'), ('Web', '9.9')) a(os_type, app_ver)
    LEFT JOIN (SELECT os_type, app_ver, CAST(sum(sum_cpu_usage) AS BIGINT) AS cpu, CAST(sum(sum_mem_usage) AS BIGINT) AS mem, CAST(sum(log_count) AS BIGINT) AS n,
        CAST(sum(error_count) AS BIGINT) AS e, CAST(sum(crash_count) AS BIGINT) AS c, round(avg(loading_time), 6) AS l, round(avg(response_time), 6) AS r,
        count(DISTINCT device_id) AS u FROM page_flow GROUP BY 1, 2) USING (os_type, app_ver)
    """,
)
def _(t: Tables):
    return versions.version_compare(t.pages, t.visits, _PAIRS)


@query(
    "all_versions",
    """
    SELECT os_type, app_ver, users, installs, loading_time, error_count, crash_count, response_time
    FROM (SELECT os_type, app_ver, count(*) AS users, count(*) FILTER (install_yn = 'Y') AS installs FROM daily_access GROUP BY 1, 2)
    LEFT JOIN (SELECT os_type, app_ver, quantile_cont(loading_time, 0.5) AS loading_time, CAST(sum(error_count) AS BIGINT) AS error_count,
               CAST(sum(crash_count) AS BIGINT) AS crash_count FROM page_flow GROUP BY 1, 2) USING (os_type, app_ver)
    LEFT JOIN (SELECT os_type, app_ver, round(avg(intervaltime), 6) AS response_time FROM network_log GROUP BY 1, 2) USING (os_type, app_ver)
    """,
)
def _(t: Tables):
    return versions.all_versions(t.visits, t.pages, t.network)


@query(
    "version_series",
    """
    SELECT os_type, app_ver, CAST(bucket AS VARCHAR) AS bucket, coalesce(u, 0) AS users, coalesce(tr, 0) AS troubled, coalesce(l, 0) AS loading_time, coalesce(r, 0) AS response_time
    FROM (SELECT os_type, app_ver, CAST(make_timestamp(app_start_tm * 1000) AS DATE) AS bucket, count(DISTINCT device_id) AS u FROM daily_access GROUP BY 1, 2, 3)
    FULL JOIN (SELECT os_type, app_ver, log_date AS bucket, count(DISTINCT device_id) AS tr FROM trouble_log GROUP BY 1, 2, 3) USING (os_type, app_ver, bucket)
    FULL JOIN (SELECT os_type, app_ver, log_date AS bucket, quantile_cont(loading_time, 0.5) AS l FROM page_flow WHERE loading_time IS NOT NULL GROUP BY 1, 2, 3) USING (os_type, app_ver, bucket)
    FULL JOIN (SELECT os_type, app_ver, log_date AS bucket, round(avg(intervaltime), 6) AS r FROM network_log GROUP BY 1, 2, 3) USING (os_type, app_ver, bucket)
    """,
)
def _(t: Tables):
    return versions.version_series(t.visits, t.trouble, t.pages, t.network)


@query(
    "version_conversion",
    """
    SELECT os_type, app_ver, u AS "user", CAST(floor(u / U * 100 + 0.5) AS BIGINT) AS user_rate, e AS error, CAST(floor(e / E2 * 100 + 0.5) AS BIGINT) AS error_rate,
           c AS crash, CAST(floor(c / C2 * 100 + 0.5) AS BIGINT) AS crash_rate
    FROM (SELECT os_type, CASE WHEN rn <= 2 THEN app_ver ELSE 'Others' END AS app_ver, CAST(sum(u) AS BIGINT) AS u, CAST(sum(e) AS BIGINT) AS e, CAST(sum(c) AS BIGINT) AS c FROM r GROUP BY 1, 2)
    JOIN (SELECT os_type, sum(u) AS U, sum(e) AS E2, sum(c) AS C2 FROM r GROUP BY 1) t USING (os_type)
    """.replace("u / U", "u / UU").replace("sum(u) AS U,", "sum(u) AS UU,"),
    ctes="""
    r AS (SELECT os_type, app_ver, u, coalesce(e, 0) AS e, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY os_type ORDER BY u DESC, app_ver) AS rn
      FROM (SELECT os_type, app_ver, count(*) AS u FROM daily_access GROUP BY 1, 2)
      LEFT JOIN (SELECT os_type, app_ver, count(*) FILTER (log_type <> 2097152) AS e, count(*) FILTER (log_type = 2097152) AS c FROM trouble_log GROUP BY 1, 2) USING (os_type, app_ver))
    """,
)
def _(t: Tables):
    return versions.version_conversion(t.visits, t.trouble, top=2)


@query(
    "version_daily_share",
    """
    SELECT CAST(log_date AS VARCHAR) AS log_date, os_type, app_ver, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY log_date, os_type), 1) AS rate
    FROM daily_access GROUP BY daily_access.log_date, os_type, app_ver
    """,
)
def _(t: Tables):
    return versions.version_daily_share(t.visits)


@query(
    "crash_by_version",
    """
    SELECT os_type, app_ver, u AS "user", c AS crash_count, floor(c / sum(c) OVER () * 1000 + 0.5) / 10 AS crash_rate
    FROM (SELECT os_type, app_ver, count(*) AS u FROM daily_access GROUP BY 1, 2) FULL JOIN
         (SELECT os_type, app_ver, CAST(sum(crash_count) AS BIGINT) AS c FROM page_flow GROUP BY 1, 2) USING (os_type, app_ver)
    """,
)
def _(t: Tables):
    return versions.crash_by_version(t.visits, t.pages)


_REPORT = """
count(*) AS pv, count(DISTINCT device_id) AS users, round(avg(response_time), 6) AS response_time, round(avg(loading_time), 6) AS loading_time,
round(avg(sum_cpu_usage), 6) AS cpu_usage, round(avg(sum_mem_usage), 6) AS mem_usage, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(crash_count) AS BIGINT) AS crash_count
"""


@query(
    "version_report",
    f"SELECT CAST(CAST(page_start_tm_dt + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, os_type, app_ver, {_REPORT} FROM page_flow WHERE CAST(page_start_tm_dt + INTERVAL 9 HOUR AS DATE) {_RANGE} GROUP BY 1, 2, 3",
)
def _(t: Tables):
    return versions.version_report(t.pages, _FROM, _TO, tz="Asia/Seoul")


@query("version_report_total", f"SELECT CAST(log_date AS VARCHAR) AS day, {_REPORT} FROM page_flow WHERE log_date {_RANGE} GROUP BY 1")
def _(t: Tables):
    return versions.version_report(t.pages, _FROM, _TO, by_version=False)


@query(
    "trouble_report",
    """
    SELECT log_name, os_type, log_type, app_ver, log_tm, user_id, count(*) AS cnt FROM trouble_log WHERE log_type = 131077 AND user_id IS NOT NULL GROUP BY ALL
    """,
)
def _(t: Tables):
    return versions.trouble_report(t.trouble)


@query(
    "crash_report",
    """
    SELECT 'Fatal: e' || (k % 10) AS occurrence, os_type, log_type, app_ver, log_tm, user_id, count(*) AS cnt FROM trouble_log WHERE log_type = 2097152 AND user_id IS NOT NULL GROUP BY ALL
    """,
)
def _(t: Tables):
    stack = F.expr(r"concat(' Fatal: e', k % 10, ' \n  at a.b(c.java:', k, ')\n  at d.e(f.java:1)')")
    return versions.crash_report(t.trouble.withColumn("res_msg", stack))


@query(
    "trouble_report_latest",
    """
    SELECT log_name, os_type, app_ver, count(*) AS cnt, max(log_tm) AS last_tm, arg_max(user_id, (log_tm, user_id)) AS last_user
    FROM trouble_log WHERE log_type = 131077 AND user_id IS NOT NULL GROUP BY 1, 2, 3
    """,
)
def _(t: Tables):
    return versions.latest_of_report(versions.trouble_report(t.trouble), ["log_name", "os_type", "app_ver"])


@query(
    "response_summary",
    """
    SELECT os_type, app_ver, count(*) AS cnt, max(intervaltime) AS max_value, min(intervaltime) AS min_value, quantile_cont(intervaltime, 0.5) AS med_value,
           round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS rate FROM network_log GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return versions.response_summary(t.network, "intervaltime")


@query(
    "top_trouble_devices",
    "SELECT device_model, CAST(sum(error_count) AS BIGINT) AS error_count, count(DISTINCT device_id) AS users, max(os_type) AS os_type FROM page_flow GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t: Tables):
    return versions.top_trouble_devices(t.pages)


@query(
    "top_crash_devices",
    "SELECT device_model, CAST(sum(crash_count) AS BIGINT) AS crash_count, count(DISTINCT device_id) AS users, max(os_type) AS os_type FROM page_flow GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t: Tables):
    return versions.top_trouble_devices(t.pages, "crash_count")


@query(
    "page_report",
    """
    SELECT page_name, count(*) AS views, count(DISTINCT device_id) AS viewers, round(avg(intervaltime), 6) AS stay, round(avg(loading_time), 6) AS loading_time,
           CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(crash_count) AS BIGINT) AS crash_count FROM page_flow GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
    """,
)
def _(t: Tables):
    return versions.page_report(t.pages)


@query(
    "message_groups",
    """
    SELECT log_name, CAST(sum(n) AS BIGINT) AS cnt, string_agg(CAST(log_type AS VARCHAR), '|' ORDER BY log_type) AS log_types
    FROM (SELECT log_name, log_type, count(*) AS n FROM trouble_log GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
)
def _(t: Tables):
    return versions.message_groups(t.trouble)


_SQL_STATES = {
    "total": "true", "active": "active_st = 'Y'",
    "normal": "active_st = 'Y' AND device_st IN ('N', 'R') AND reinstalled_date IS NULL",
    "dormant": "active_st = 'N' AND device_st = 'S' AND sleep_date IS NOT NULL", "inactive": "active_st = 'N'",
    "reinstalled": "active_st = 'Y' AND reinstalled_date IS NOT NULL", "deleted": "deleted_date IS NOT NULL",
    "vip": "active_st = 'Y' AND device_st IN ('N', 'R') AND reinstalled_date IS NULL AND vip_yn = 'Y'",
    "non_vip": "active_st = 'Y' AND device_st IN ('N', 'R') AND reinstalled_date IS NULL AND vip_yn = 'N'",
}


@query(
    "device_lifecycle",
    f"SELECT package_nm, server_type, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _SQL_STATES.items())} FROM device_info GROUP BY 1, 2",
)
def _(t: Tables):
    return devices.device_lifecycle(t.devices)


def _growth(state: str) -> str:
    return f"""
    SELECT package_nm, server_type, CAST(d AS VARCHAR) AS created_date, coalesce(n, 0) AS cnt,
           CAST(sum(coalesce(n, 0)) OVER (PARTITION BY package_nm, server_type ORDER BY d) AS BIGINT) AS total
    FROM (SELECT package_nm, server_type, CAST(unnest(generate_series(CAST(min(created_date) AS TIMESTAMP), CAST(max(created_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
          FROM device_info WHERE {_SQL_STATES[state]} GROUP BY 1, 2)
    LEFT JOIN (SELECT package_nm, server_type, created_date AS d, count(*) AS n FROM device_info WHERE {_SQL_STATES[state]} GROUP BY 1, 2, 3) USING (package_nm, server_type, d)
    """


@query("device_growth", _growth("total"))
def _(t: Tables):
    return devices.device_growth(t.devices, "total")


@query("device_growth_normal", _growth("normal"))
def _(t: Tables):
    return devices.device_growth(t.devices, "normal")


@query("lifecycle_users", f"SELECT device_id, device_model, CAST(sleep_date AS VARCHAR) AS sleep_date FROM device_info WHERE {_SQL_STATES['dormant']}")
def _(t: Tables):
    return devices.lifecycle_users(t.devices, "dormant").select("device_id", "device_model", "sleep_date")


@query(
    "retention",
    f"""
    SELECT package_nm, server_type, CAST(log_date AS VARCHAR) AS log_date, retention_day, count(*) AS cnt, CASE WHEN retention_day >= 2 THEN 'Y' ELSE 'N' END AS revisit
    FROM daily_access WHERE daily_access.log_date {_RANGE} GROUP BY 1, 2, daily_access.log_date, 4
    """,
)
def _(t: Tables):
    return devices.retention(t.visits, _FROM, _TO)


@query(
    "access_counts",
    f"""
    SELECT package_nm, server_type, count(DISTINCT device_id) AS connects, count(*) FILTER (login_yn = 'Y') AS logins, count(*) FILTER (login_yn <> 'Y') AS not_logins,
           round(avg(using_time), 6) AS avg_using_time FROM daily_access WHERE log_date {_RANGE} GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return devices.access_counts(t.visits, _FROM, _TO)


@query("use_time_distribution", f"SELECT package_nm, server_type, using_time // {tg.HOUR} * {tg.HOUR} AS bucket, count(*) AS cnt FROM daily_access GROUP BY 1, 2, 3")
def _(t: Tables):
    return devices.use_time_distribution(t.visits, tg.HOUR)


@query(
    "daily_use_time",
    f"""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS log_date, coalesce(a, 0) AS avg_using_time FROM generate_series(TIMESTAMP '{_FROM}', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) g(d)
    LEFT JOIN (SELECT log_date, round(avg(using_time), 6) AS a FROM daily_access GROUP BY 1) ON log_date = CAST(d AS DATE)
    """,
)
def _(t: Tables):
    return devices.daily_use_time(t.visits, _FROM, dt.date(2024, 2, 4))


@query("sleep_counts", f"SELECT package_nm, server_type, count(*) AS sleeps FROM device_info WHERE device_st = 'S' AND sleep_date BETWEEN DATE '{_FROM}' AND DATE '{_D}' GROUP BY 1, 2")
def _(t: Tables):
    return devices.sleep_counts(t.devices, _FROM, _D)


@query(
    "models_by_os",
    """
    SELECT os_type, device_model, count(DISTINCT device_id) AS devices FROM event_log GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY os_type ORDER BY count(DISTINCT device_id) DESC, device_model) <= 10
    """,
)
def _(t: Tables):
    return devices.models_by_os(t.events)


@query(
    "status_series",
    f"""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS log_date, coalesce(connect, 0) AS connect, coalesce(install, 0) AS install, coalesce(login, 0) AS login, coalesce(reconnect, 0) AS reconnect,
           coalesce(avg_use_time, 0) AS avg_use_time, coalesce(sleep, 0) AS sleep, coalesce(use_cnt, 0) AS use, coalesce(error, 0) AS error, coalesce(crash, 0) AS crash
    FROM generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) g(d)
    LEFT JOIN (SELECT log_date, count(DISTINCT device_id) AS connect, count(*) FILTER (install_yn = 'Y') AS install, count(*) FILTER (login_yn = 'Y') AS login,
        count(*) FILTER (retention_day >= 2) AS reconnect, round(avg(using_time), 6) AS avg_use_time FROM daily_access GROUP BY 1) a ON a.log_date = CAST(d AS DATE)
    LEFT JOIN (SELECT sleep_date, count(*) AS sleep FROM device_info WHERE device_st = 'S' GROUP BY 1) s ON s.sleep_date = CAST(d AS DATE)
    LEFT JOIN (SELECT log_date, count(*) AS use_cnt FROM page_flow GROUP BY 1) p ON p.log_date = CAST(d AS DATE)
    LEFT JOIN (SELECT log_date, count(*) FILTER (log_type <> 2097152) AS error, count(*) FILTER (log_type = 2097152) AS crash FROM trouble_log GROUP BY 1) t ON t.log_date = CAST(d AS DATE)
    """,
)
def _(t: Tables):
    return devices.status_series(t.visits, t.devices, t.pages, t.trouble, dt.date(2024, 1, 20), dt.date(2024, 2, 2))


@query(
    "period_bi",
    f"""
    SELECT package_nm, server_type, installs, logins, users, min_use_time, avg_use_time, max_use_time, deletes, sleeps, uses, errors, crashes
    FROM (SELECT package_nm, server_type, count(*) FILTER (install_yn = 'Y') AS installs, count(*) FILTER (login_yn = 'Y') AS logins, count(DISTINCT device_id) AS users,
        min(nullif(using_time, 0)) AS min_use_time, round(avg(nullif(using_time, 0)), 6) AS avg_use_time, max(nullif(using_time, 0)) AS max_use_time
        FROM daily_access WHERE log_date BETWEEN DATE '{_FROM}' AND DATE '{_D}' GROUP BY 1, 2)
    JOIN (SELECT package_nm, server_type, count(*) FILTER (deleted_date BETWEEN DATE '{_FROM}' AND DATE '{_D}') AS deletes,
        count(*) FILTER (device_st = 'S' AND sleep_date BETWEEN DATE '{_FROM}' AND DATE '{_D}') AS sleeps FROM device_info GROUP BY 1, 2) USING (package_nm, server_type)
    JOIN (SELECT package_nm, server_type, count(*) AS uses FROM page_flow WHERE log_date BETWEEN DATE '{_FROM}' AND DATE '{_D}' GROUP BY 1, 2) USING (package_nm, server_type)
    JOIN (SELECT package_nm, server_type, count(*) FILTER (log_type <> 2097152) AS errors, count(*) FILTER (log_type = 2097152) AS crashes
        FROM trouble_log WHERE log_date BETWEEN DATE '{_FROM}' AND DATE '{_D}' GROUP BY 1, 2) USING (package_nm, server_type)
    """,
)
def _(t: Tables):
    return devices.period_bi(t.visits, t.devices, t.pages, t.trouble, _FROM, _D)


@query("models_of_one_os", "SELECT os_type, device_model, count(DISTINCT device_id) AS devices FROM event_log WHERE os_type = 'iOS' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10")
def _(t: Tables):
    return devices.models_by_os(t.events, "iOS")


_HOUR = "CAST(date_trunc('hour', make_timestamp({} * 1000)) AS VARCHAR)"


@query(
    "version_users_hourly",
    f"""
    SELECT os_type, app_ver, bucket, coalesce(u, 0) AS users, coalesce(tr, 0) AS troubled, coalesce(l, 0) AS loading_time, coalesce(r, 0) AS response_time
    FROM (SELECT os_type, app_ver, {_HOUR.format("app_start_tm")} AS bucket, count(DISTINCT device_id) AS u FROM daily_access GROUP BY 1, 2, 3)
    FULL JOIN (SELECT os_type, app_ver, {_HOUR.format("log_tm")} AS bucket, count(DISTINCT device_id) AS tr FROM trouble_log GROUP BY 1, 2, 3) USING (os_type, app_ver, bucket)
    FULL JOIN (SELECT os_type, app_ver, {_HOUR.format("page_start_tm")} AS bucket, quantile_cont(loading_time, 0.5) AS l FROM page_flow WHERE loading_time IS NOT NULL GROUP BY 1, 2, 3) USING (os_type, app_ver, bucket)
    FULL JOIN (SELECT os_type, app_ver, {_HOUR.format("log_tm")} AS bucket, round(avg(intervaltime), 6) AS r FROM network_log GROUP BY 1, 2, 3) USING (os_type, app_ver, bucket)
    """,
)
def _(t: Tables):
    return versions.version_series(t.visits, t.trouble, t.pages, t.network, "hour")
