"""KPI series, cards and counters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.operators import kpi
from tidemark.plans.registry import Tables, query
from tidemark.sources import driver_tables as dtb

_D, _FIRST = dtb.AS_OF, dtb.FIRST_DAY

# device_statistic for every day of the data, written the plain way.
STATISTIC_CTES = """
days AS (SELECT DISTINCT log_date AS stat_date FROM event_log),
seen AS (SELECT DISTINCT package_nm, server_type, os_type, device_id, log_date FROM access_history),
day_users AS (
  SELECT stat_date, package_nm, server_type, os_type, count(*) FILTER (d) AS dau, count(*) FILTER (d AND w) AS revisit_7d, count(*) AS mau
  FROM (SELECT stat_date, package_nm, server_type, os_type, device_id, bool_or(log_date = stat_date) AS d,
               bool_or(log_date >= stat_date - 7 AND log_date < stat_date) AS w
        FROM days JOIN seen ON log_date BETWEEN stat_date - 30 AND stat_date GROUP BY ALL)
  GROUP BY ALL HAVING count(*) FILTER (d) > 0),
day_visits AS (
  SELECT log_date AS stat_date, package_nm, server_type, os_type, CAST(sum(visit_cnt) AS BIGINT) AS visit,
         CAST(sum(install_cnt) AS BIGINT) AS install, CAST(sum(login_cnt) AS BIGINT) AS login FROM access_history GROUP BY ALL),
day_pages AS (
  SELECT log_date AS stat_date, package_nm, server_type, os_type, CAST(sum(crash_count) AS BIGINT) AS crash_count,
         CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(js_error_count) AS BIGINT) AS js_error_count,
         CAST(sum(log_count) AS BIGINT) AS log_count, round(avg(intervaltime), 6) AS intervaltime_avg, round(avg(lcp), 6) AS lcp_avg,
         round(avg(ttfb), 6) AS ttfb_avg, round(avg(fcp), 6) AS fcp_avg, round(avg(inp), 6) AS inp_avg, count(*) AS pv
  FROM page_flow GROUP BY ALL),
device_statistic AS (
  SELECT stat_date, package_nm, server_type, os_type, coalesce(visit, 0) AS visit, coalesce(install, 0) AS install,
         coalesce(login, 0) AS login, coalesce(dau, 0) AS dau, coalesce(revisit_7d, 0) AS revisit_7d, coalesce(mau, 0) AS mau,
         coalesce(crash_count, 0) AS crash_count, coalesce(error_count, 0) AS error_count, coalesce(js_error_count, 0) AS js_error_count,
         coalesce(log_count, 0) AS log_count, coalesce(intervaltime_avg, 0) AS intervaltime_avg, coalesce(lcp_avg, 0) AS lcp_avg,
         coalesce(ttfb_avg, 0) AS ttfb_avg, coalesce(fcp_avg, 0) AS fcp_avg, coalesce(inp_avg, 0) AS inp_avg, coalesce(pv, 0) AS pv
  FROM day_visits FULL JOIN day_users USING (stat_date, package_nm, server_type, os_type)
  FULL JOIN day_pages USING (stat_date, package_nm, server_type, os_type))
"""


@query("statistic_history", "SELECT * REPLACE (CAST(stat_date AS VARCHAR) AS stat_date) FROM device_statistic", ctes=STATISTIC_CTES)
def _(t: Tables):
    return t.statistic


_SERIES = f"""
SELECT CAST(stat_date AS VARCHAR) AS stat_date, os_type, CAST(sum(install) AS BIGINT) AS install, CAST(sum(login) AS BIGINT) AS login,
       CAST(sum(dau) AS BIGINT) AS dau, CAST(sum(revisit_7d) AS BIGINT) AS revisit_7d, CAST(sum(mau) AS BIGINT) AS mau,
       CAST(sum(pv) AS BIGINT) AS pv, round(avg(intervaltime_avg), 8) AS intervaltime_avg, CAST(sum(log_count) AS BIGINT) AS log_count,
       CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(js_error_count) AS BIGINT) AS js_error_count,
       CAST(sum(crash_count) AS BIGINT) AS crash_count
FROM device_statistic WHERE stat_date BETWEEN DATE '2024-01-05' AND DATE '{_D}' GROUP BY ALL
"""


@query("metric_series", _SERIES, ctes=STATISTIC_CTES)
def _(t: Tables):
    return kpi.metric_series(t.statistic, dt.date(2024, 1, 5), _D)


@query(
    "install_series",
    "SELECT CAST(stat_date AS VARCHAR) AS stat_date, os_type, CAST(sum(install) AS BIGINT) AS install FROM device_statistic GROUP BY ALL",
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    return kpi.install_series(t.statistic, _FIRST, _D)


@query(
    "mau_monthly",
    "SELECT CAST(CAST(date_trunc('month', stat_date) AS DATE) AS VARCHAR) AS stat_month, os_type, max(mau) AS mau FROM device_statistic GROUP BY ALL",
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    return kpi.mau_monthly(t.statistic, _FIRST, _D)


@query(
    "overview",
    """
    SELECT CAST(log_date AS VARCHAR) AS log_date, count(*) AS pv, count(DISTINCT device_id) AS uv,
           round(sum(error_count + crash_count) / count(*), 4) AS error_rate
    FROM page_flow WHERE log_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1 ORDER BY 1 LIMIT 14
    """,
)
def _(t: Tables):
    return kpi.overview(kpi.daily_overview(t.pages), dt.date(2024, 1, 5), dt.date(2024, 1, 25), 14)


@query(
    "zero_fill_series",
    f"""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS stat_date, coalesce(a, 0) AS android_install, coalesce(i, 0) AS ios_install
    FROM generate_series(greatest(TIMESTAMP '2023-12-25', (SELECT min(stat_date) FROM device_statistic WHERE os_type IN ('Android', 'iOS'))), TIMESTAMP '2024-02-03', INTERVAL 1 DAY) g(d)
    LEFT JOIN (SELECT stat_date, CAST(sum(install) FILTER (os_type = 'Android') AS BIGINT) AS a, CAST(sum(install) FILTER (os_type = 'iOS') AS BIGINT) AS i
               FROM device_statistic GROUP BY 1) ON stat_date = CAST(d AS DATE)
    """,
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    series = kpi.install_series(t.statistic, dt.date(2023, 12, 25), dt.date(2024, 2, 3))
    return kpi.zero_fill_series(series, "install", dt.date(2023, 12, 25), dt.date(2024, 2, 3))


@query(
    "zero_fill_series_monthly",
    """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS stat_month, coalesce(a, 0) AS android_mau, coalesce(i, 0) AS ios_mau
    FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH) g(d)
    LEFT JOIN (SELECT date_trunc('month', stat_date) AS m, max(mau) FILTER (os_type = 'Android') AS a, max(mau) FILTER (os_type = 'iOS') AS i
               FROM device_statistic GROUP BY 1) ON m = d
    """,
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    start, end = dt.date(2023, 11, 5), dt.date(2024, 3, 9)
    return kpi.zero_fill_series(kpi.mau_monthly(t.statistic, start, end), "mau", start, end, "month", "stat_month")


@query(
    "clamp_selected",
    """
    SELECT CAST(stat_date AS VARCHAR) AS stat_date, CAST(sum(install) FILTER (os_type = 'Android') AS BIGINT) AS android_install,
           CAST(sum(install) FILTER (os_type = 'iOS') AS BIGINT) AS ios_install
    FROM device_statistic WHERE stat_date = (SELECT min(stat_date) FROM device_statistic WHERE os_type <> 'Web') GROUP BY 1
    """,
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    series = kpi.zero_fill_series(kpi.install_series(t.statistic, _FIRST, _D), "install", dt.date(2023, 12, 25), _D)
    return kpi.clamp_selected(series, dt.date(2023, 12, 28))


@query(
    "kpi_card",
    f"""
    SELECT id, name, CAST(CASE WHEN name = 'android' THEN share WHEN name = 'ios' THEN 100 - share ELSE today END AS BIGINT) AS today,
           CAST(yesterday AS BIGINT) AS yesterday
    FROM (SELECT t.*, CAST(trunc(100.0 * t_android / (t_android + t_ios)) AS BIGINT) AS share FROM sides t),
    LATERAL (VALUES (0, 'install', t_install, y_install), (1, 'android', 0, 0), (2, 'ios', 0, 0), (3, 'mau', t_mau, y_mau), (4, 'ccu', 0, 0),
      (5, 'pv', t_pv, y_pv), (6, 'revisit', t_rev, y_rev), (7, 'sleep', 0, 0), (8, 'login', t_login, y_login),
      (9, 'stay', CAST(trunc(t_stay) AS BIGINT), CAST(trunc(y_stay) AS BIGINT)), (10, 'log', t_log, y_log), (11, 'error', t_err, y_err), (12, 'crash', t_crash, y_crash),
      (13, 'dau', t_dau, y_dau)) v(id, name, today, yesterday)
    """,
    ctes=STATISTIC_CTES
    + f""",
sides AS (
  SELECT {", ".join(
      f"CAST(sum({expr}) FILTER (stat_date = DATE '{_D}' - {back}) AS {kind}) AS {side}_{name}"
      for side, back in (("t", 0), ("y", 1))
      for name, expr, kind in (("install", "install", "BIGINT"), ("mau", "mau", "BIGINT"), ("pv", "pv", "BIGINT"), ("rev", "revisit_7d", "BIGINT"),
          ("login", "login", "BIGINT"), ("stay", "intervaltime_avg", "DOUBLE"), ("log", "log_count", "BIGINT"),
          ("err", "error_count + js_error_count", "BIGINT"), ("crash", "crash_count", "BIGINT"), ("dau", "dau", "BIGINT"))
  )}, sum(dau) FILTER (stat_date = DATE '{_D}' AND os_type = 'Android') AS t_android,
  sum(dau) FILTER (stat_date = DATE '{_D}' AND os_type = 'iOS') AS t_ios
  FROM device_statistic WHERE os_type IN ('Android', 'iOS'))
""",
)
def _(t: Tables):
    return kpi.kpi_card(t.statistic, _D)


@query(
    "trouble_stackmax",
    f"""
    SELECT package_nm, server_type, round(sum(c) / 7, 4) AS avg_crash, round(sum(e) / 7, 4) AS avg_error,
           CAST(ceil(sum(c) / 7) AS BIGINT) AS stack_max_crash, CAST(ceil(sum(e) / 7) AS BIGINT) AS stack_max_error
    FROM (SELECT package_nm, server_type, CASE WHEN log_type = 2097152 THEN 1 ELSE 0 END AS c, CASE WHEN log_type <> 2097152 THEN 1 ELSE 0 END AS e
          FROM trouble_log WHERE log_date BETWEEN DATE '{_D}' - 7 AND DATE '{_D}' - 1) GROUP BY 1, 2
    """,
)
def _(t: Tables):
    return kpi.trouble_stackmax(t.trouble, _D)


@query(
    "trouble_today",
    f"""
    SELECT package_nm, server_type, count(*) FILTER (log_type = 2097152) AS crash_count, count(*) FILTER (log_type <> 2097152) AS error_count
    FROM trouble_log WHERE log_date = DATE '{_D}' GROUP BY ALL
    """,
)
def _(t: Tables):
    return kpi.trouble_today(t.trouble, _D)


@query(
    "snapshot_delta",
    """
    SELECT package_nm, server_type, CAST(log_date AS VARCHAR) AS log_date, crash_count, error_count,
           greatest(0, crash_count - coalesce(lag(crash_count) OVER w, 0)) AS crash_count_delta,
           greatest(0, error_count - coalesce(lag(error_count) OVER w, 0)) AS error_count_delta
    FROM (SELECT package_nm, server_type, log_date, count(*) FILTER (log_type = 2097152) AS crash_count,
                 count(*) FILTER (log_type <> 2097152) AS error_count FROM trouble_log GROUP BY ALL)
    WINDOW w AS (PARTITION BY package_nm, server_type ORDER BY log_date)
    """,
)
def _(t: Tables):
    snapshots = kpi.trouble_counts(t.trouble, ["package_nm", "server_type", "log_date"])
    return kpi.snapshot_delta(snapshots, ["package_nm", "server_type"], "log_date", ["crash_count", "error_count"])


@query(
    "incremental_counts",
    """
    SELECT package_nm, server_type, count(*) AS log_count, epoch_us(max(log_tm_dt)) AS last_us FROM event_log
    WHERE log_tm_dt > TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL
    """,
)
def _(t: Tables):
    found = kpi.incremental_counts(t.events, dt.datetime(2024, 1, 15, 12, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 30), ts="log_tm_dt")
    return found.select("package_nm", "server_type", "log_count", F.unix_micros("last_reg_dt").alias("last_us"))


@query(
    "top_n_other",
    """
    SELECT log_name, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 4) AS rate, is_other FROM (
      SELECT CASE WHEN rn <= 10 THEN log_name ELSE 'Other' END AS log_name, CAST(sum(n) AS BIGINT) AS cnt, CASE WHEN rn <= 10 THEN 0 ELSE 1 END AS is_other
      FROM (SELECT log_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, log_name) AS rn FROM trouble_log GROUP BY 1) GROUP BY 1, 3)
    """,
)
def _(t: Tables):
    return kpi.top_n_other(t.trouble.withColumn("one", F.lit(1)), "log_name", "one")


@query(
    "web_bi",
    f"""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS log_date, coalesce(pv, 0) AS count_pv, coalesce(dau, 0) AS count_dau, avg_use_time, avg_lcp, avg_inp,
           avg_cls, avg_fcp, avg_ttfb, coalesce(err, 0) AS count_error, coalesce(new, 0) AS count_new
    FROM generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) g(d)
    LEFT JOIN (SELECT log_date, count(*) AS pv, count(DISTINCT device_id) AS dau, round(avg(intervaltime), 6) AS avg_use_time, round(avg(lcp), 6) AS avg_lcp,
        round(avg(inp), 6) AS avg_inp, round(avg(cls), 6) AS avg_cls, round(avg(fcp), 6) AS avg_fcp, round(avg(ttfb), 6) AS avg_ttfb
        FROM page_flow GROUP BY 1) p ON p.log_date = CAST(d AS DATE)
    LEFT JOIN (SELECT log_date, count(*) AS err FROM trouble_log GROUP BY 1) e ON e.log_date = CAST(d AS DATE)
    LEFT JOIN (SELECT log_date, CAST(sum(install_cnt) AS BIGINT) AS new FROM access_history GROUP BY 1) a ON a.log_date = CAST(d AS DATE)
    """,
)
def _(t: Tables):
    return kpi.web_bi(t.pages, t.trouble, t.access, dt.date(2024, 1, 20), dt.date(2024, 2, 2))


@query(
    "web_bi_months",
    "SELECT CAST(CAST(date_trunc('month', stat_date) AS DATE) AS VARCHAR) AS base_month, max(mau) AS mau FROM device_statistic GROUP BY 1",
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    return kpi.web_bi_months(t.statistic, _FIRST, _D)


_CCU = "ccu AS (SELECT log_tm // 60000 * 60000 AS minute_ms, count(DISTINCT device_id) AS ccu FROM event_log GROUP BY 1)"


@query(
    "ccu_day",
    f"""
    SELECT m AS minute_ms, coalesce(ccu, 0) AS ccu FROM generate_series(epoch_ms(TIMESTAMP '{_D}'), epoch_ms(TIMESTAMP '{_D}') + 86340000, 60000) g(m)
    LEFT JOIN ccu ON minute_ms = m
    """,
    ctes=_CCU,
)
def _(t: Tables):
    return kpi.ccu_day(kpi.concurrent_users(t.events), _D)


@query(
    "ccu_peaks",
    """
    SELECT CAST(CAST(make_timestamp(minute_ms * 1000) AS DATE) AS VARCHAR) AS log_date, max(ccu) AS max_ccu,
           (SELECT max(ccu) FROM ccu WHERE CAST(make_timestamp(minute_ms * 1000) AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-30') AS peak
    FROM ccu WHERE CAST(make_timestamp(minute_ms * 1000) AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-30' GROUP BY 1
    """,
    ctes=_CCU,
)
def _(t: Tables):
    return kpi.ccu_peaks(kpi.concurrent_users(t.events), dt.date(2024, 1, 10), _D)


@query(
    "avg_daily_count",
    "SELECT package_nm, round(avg(n), 6) AS avg_count, count(*) AS days FROM (SELECT log_date, package_nm, count(*) AS n FROM event_log GROUP BY ALL) GROUP BY 1",
)
def _(t: Tables):
    return kpi.avg_daily_count(t.events, ["package_nm"])


@query(
    "avg_daily_devices_by_model",
    "SELECT device_model, round(avg(n), 6) AS avg_count, count(*) AS days FROM (SELECT log_date, device_model, count(DISTINCT device_id) AS n FROM event_log GROUP BY ALL) GROUP BY 1",
)
def _(t: Tables):
    return kpi.avg_daily_count(t.events, ["device_model"], distinct="device_id")


def _pack(start: str, end: str, one_day: bool) -> str:
    ranges = {
        "range": f"log_date BETWEEN DATE '{start}' AND DATE '{end}'",
        "yesterday": f"log_date = DATE '{start}' - 1" if one_day else None,
        "week": f"log_date BETWEEN DATE '{end}' - 6 AND DATE '{end}'",
        "total": "true",
    }
    cols = [
        f"count(*) FILTER (log_type = {code} AND {cond}) AS {kind}_{name}" if cond else f"CAST(NULL AS BIGINT) AS {kind}_{name}"
        for kind, code in (("pv", lt.WEB_START), ("error", lt.SCRIPT_ERROR), ("crash", lt.CRASH))
        for name, cond in ranges.items()
    ]
    return f"SELECT package_nm, server_type, {', '.join(cols)} FROM event_log GROUP BY 1, 2"


@query("count_pack", _pack("2024-01-30", "2024-01-30", True))
def _(t: Tables):
    return kpi.count_pack(t.events, _D, _D)


@query("count_pack_range", _pack("2024-01-10", "2024-01-20", False))
def _(t: Tables):
    return kpi.count_pack(t.events, dt.date(2024, 1, 10), dt.date(2024, 1, 20))


@query(
    "multi_app_summary",
    f"""
    SELECT user_no, package_nm, server_type, CAST(sum(dau) AS BIGINT) AS connect, CAST(sum(crash_count) AS BIGINT) AS crash,
           CAST(sum(error_count + js_error_count) AS BIGINT) AS error, CAST(sum(mau) AS BIGINT) AS mau
    FROM device_statistic JOIN (SELECT DISTINCT k % 3 AS user_no, package_nm, server_type FROM event_log) USING (package_nm, server_type)
    WHERE stat_date = DATE '{_D}' GROUP BY 1, 2, 3
    """,
    ctes=STATISTIC_CTES,
)
def _(t: Tables):
    apps = t.events.select((F.col("k") % 3).cast("long").alias("user_no"), "package_nm", "server_type")
    return kpi.multi_app_summary(t.statistic, apps, _D)
