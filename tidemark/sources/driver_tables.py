"""The driver's tables as event_log, page_flow and the frames derived from them."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import logtypes as lt

# The last day of the driver's events; stands for "today" in the registered queries.
AS_OF = dt.date(2024, 1, 30)
FIRST_DAY = dt.date(2024, 1, 1)
# Page views that a partition of timing entries holds: their entries, some 4 KB a view when sorted, take about 64 MB.
VIEWS_A_PART = 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
    raw = table(spark, sf_dir, "events").selectExpr("*", "CAST(ts AS TIMESTAMP) AS log_tm_dt", f"{k} AS k")
    return raw.selectExpr(
        "event_id",
        "log_tm_dt",
        "unix_millis(log_tm_dt) AS log_tm",
        "CAST(log_tm_dt AS DATE) AS log_date",
        "concat('d', user_id) AS device_id",
        "CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('u', user_id) END AS user_id",
        "concat('pkg', user_id % 2) AS package_nm",
        "CAST(0 AS BIGINT) AS server_type",
        "CASE user_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' ELSE 'Web' END AS os_type",
        "concat('1.', user_id % 4) AS app_ver",
        "concat('M', user_id % 20) AS device_model",
        "k",
        "concat('https://app/p', k % 12, '?k=', k) AS req_url",
        f"""CAST(CASE WHEN event_type = 'view' THEN {lt.WEB_START}
                 WHEN event_type = 'click' THEN {lt.WEB_CLICK}
                 WHEN event_type = 'signup' THEN {lt.APP_FIRST_START}
                 WHEN event_type = 'purchase' THEN {lt.HTTP_RESPONSE}
                 WHEN k % 10 = 0 THEN {lt.CRASH}
                 ELSE {lt.SCRIPT_ERROR} END AS BIGINT) AS log_type""",
        "CAST(floor(value * 50) AS BIGINT) AS intervaltime",
        "CAST(CASE k % 5 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS BIGINT) AS status_code",
        "event_type",
        "value",
    )


def page_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).selectExpr(
        "log_date",
        "log_tm AS page_start_tm",
        "log_tm_dt AS page_start_tm_dt",
        "log_tm + intervaltime AS page_end_tm",
        "device_id", "user_id", "package_nm", "server_type", "os_type", "app_ver", "device_model", "req_url",
        "split_part(req_url, '?', 1) AS page_name",
        "event_id AS page_id",
        "log_type",
        "CASE WHEN k % 7 = 0 THEN NULL ELSE intervaltime END AS intervaltime",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS loading_time",
        f"CASE WHEN log_type = {lt.HTTP_RESPONSE} THEN intervaltime ELSE 0L END AS response_time",
        f"CASE WHEN log_type = {lt.HTTP_RESPONSE} THEN 1L ELSE 0L END AS request_count",
        f"CASE WHEN log_type = {lt.SCRIPT_ERROR} THEN 1L ELSE 0L END AS error_count",
        f"CASE WHEN log_type = {lt.SCRIPT_ERROR} AND k % 2 = 0 THEN 1L ELSE 0L END AS js_error_count",
        f"CASE WHEN log_type = {lt.CRASH} THEN 1L ELSE 0L END AS crash_count",
        "1L AS event_count",
        "1L AS log_count",
        "CAST(k AS BIGINT) AS sum_cpu_usage",
        "CAST(k * 10 AS BIGINT) AS sum_mem_usage",
        # Multiples of a power of two, so sums are exact in any order.
        "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(floor(value * 10) AS DOUBLE) END AS lcp",
        "CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(floor(value * 4) AS DOUBLE) / 4 END AS inp",
        "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) / 1024 END AS cls",
        "CAST(floor(value * 5) AS DOUBLE) AS fcp",
        "CAST(floor(value * 2) AS DOUBLE) AS ttfb",
    )


def trouble_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_log(spark, sf_dir).filter(F.col("log_type").isin(lt.SCRIPT_ERROR, lt.CRASH))
    return events.withColumn(
        "log_name",
        F.concat(F.when(F.col("log_type") == lt.CRASH, "C").otherwise("E"), (F.col("k") % 10).cast("string")),
    )


def network_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_log(spark, sf_dir).filter(F.col("log_type") == lt.HTTP_RESPONSE)
    group = F.concat(F.expr("status_code div 100").cast("string"), F.lit("xx"))
    return events.withColumn("status_group", group)


def vital_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page vitals as rows of (name, value, rating)."""
    pages = page_flow(spark, sf_dir).withColumn("log_tm", F.col("page_start_tm"))
    ids = ["log_tm", "log_date", "device_id", "package_nm", "server_type", "os_type", "page_name", "page_id"]
    names = ["lcp", "inp", "cls", "fcp", "ttfb"]
    rows = pages.select(*ids, *names).unpivot(ids, names, "name", "value").filter("value IS NOT NULL")
    rating = "CASE WHEN value < 100 THEN 'good' WHEN value < 500 THEN 'needs-improvement' ELSE 'poor' END"
    return rows.withColumn("rating", F.expr(rating))


def mkt_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "package_nm AS application_id",
        "server_type",
        "coalesce(user_id, '') AS user_id",
        "device_id",
        "coalesce(user_id, device_id) AS user_key",
        "event_type AS event_name",
        "log_tm_dt AS event_time",
        "log_tm",
        "os_type AS platform",
        "app_ver AS app_version",
        "device_model",
        "concat('{\"k\": ', k, '}') AS event_params",
        "'{}' AS user_properties",
        "CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS BIGINT) AS is_first_open",
        "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS is_important_event",
    )


def device_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per device: first and last day, lifecycle state, VIP flag."""
    number = F.substring("device_id", 2, 20).cast("bigint")
    per_device = (
        event_log(spark, sf_dir)
        .groupBy("device_id", "package_nm", "server_type", "os_type", "device_model")
        .agg(
            F.min("log_date").alias("created_date"),
            F.max("log_date").alias("last_date"),
            F.max(F.when(F.col("log_type") == lt.APP_FIRST_START, F.col("log_date"))).alias("last_install"),
            F.count_if(F.col("log_type") == lt.APP_FIRST_START).alias("installs"),
        )
    )
    idle = F.date_diff(F.lit(AS_OF), F.col("last_date"))
    # The driver's devices are seen almost daily, so a device sleeps after one idle day here.
    return per_device.select(
        "device_id", "package_nm", "server_type", "os_type", "device_model", "created_date", "last_date",
        F.when(idle >= 1, "N").otherwise("Y").alias("active_st"),
        F.when(idle >= 1, "S").when(F.col("installs") > 12, "R").otherwise("N").alias("device_st"),
        F.when(number % 5 == 0, "Y").otherwise("N").alias("vip_yn"),
        F.when(F.col("installs") > 12, F.col("last_install")).alias("reinstalled_date"),
        F.when(idle >= 1, F.date_add("last_date", 1)).alias("sleep_date"),
        F.when(idle >= 2, F.date_add("last_date", 2)).alias("deleted_date"),
    )


def daily_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per device and day: first and last log, use time, login and install flags, days since created."""
    events = event_log(spark, sf_dir)
    days = events.groupBy("log_date", "device_id", "package_nm", "server_type", "os_type", "app_ver", "device_model").agg(
        F.min("log_tm").alias("app_start_tm"),
        (F.max("log_tm") - F.min("log_tm")).alias("using_time"),
        F.when(F.count("user_id") > 0, "Y").otherwise("N").alias("login_yn"),
        F.when(F.bool_or(F.col("log_type") == lt.APP_FIRST_START), "Y").otherwise("N").alias("install_yn"),
    )
    created = events.groupBy("device_id").agg(F.min("log_date").alias("created_date"))
    age = F.date_diff("log_date", "created_date") + 1
    return days.join(created, "device_id").withColumn("retention_day", age.cast("long"))


def perf_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser timing entries of each page view, as JSON text with short keys."""

    def entry(**pairs: str) -> str:
        parts = [f"concat('\"{key.lstrip('_')}\":', {value})" for key, value in pairs.items()]
        return f"concat('{{', concat_ws('^', {', '.join(parts)}), '}}')"

    def text(expr: str) -> str:
        return f"concat('\"', {expr}, '\"')"

    image = "concat('https://cdn.app/img', k % 7, '.png')"
    entries = [
        entry(_1=text("req_url"), _2="'\"navigation\"'", _3="'1.0'", _4="80 + k", _18="10 + k % 5", _13="k % 3", _14="k % 3 + 2", _15="'4'",
              _17="9 + k % 4", _16="IF(k % 2 = 0, 6, 0)", _19="20 + k", _22="30 + k", _47="50 + k", _50="80 + k", _48="75 + k",
              _45="45 + k", _10="'0'", _11="k % 6", _12="'2'", _23="k * 1000", _26="status_code"),
        entry(_1=text(image), _2="'\"resource\"'", _3="40 + k % 10", _4="'15.5'", _5="'\"img\"'", _23="k * 30000", _26="'200'"),
        entry(_1="'\"https://js.app/s.js\"'", _2="'\"resource\"'", _3="'35'", _4="'20'", _5="'\"script\"'", _23="'512'", _26="'200'"),
        entry(url=text(image), size="k * 10", _2="'\"largest-contentful-paint\"'", _3="'45'", _42="'[{\"3\":1}]'"),
        entry(_1="'\"self\"'", _2="'\"longtask\"'", _3="'60'", _4="50 + k % 40"),
        entry(_1="'\"click\"'", _2="'\"first-input\"'", _3="k % 4", _4="'8'"),
        entry(_1="'\"click\"'", _2="'\"event\"'", _3="'90'", _4="'16'"),
        entry(_1="'\"//cdn.b/y.js\"'", _2="'\"resource\"'", _3="'70'", _4="'5'", _5="'\"other\"'", _23="'100'", _26="'200'"),
        # Text that breaks off.
        "concat('{\"1\":\"cut', k)",
    ]
    views = event_log(spark, sf_dir).selectExpr("device_id", "event_id AS page_id", "log_tm", "req_url", "k", "status_code")
    # The entries are made here, next to their page view, where later steps need them. Adaptive execution would size partitions by the
    # bytes of the views, a fiftieth of what their entries take, so the number follows from the rows; the count reads no column.
    parts = math.ceil(table(spark, sf_dir, "events").count() / VIEWS_A_PART)
    views = views.repartition(max(parts, spark.sparkContext.defaultParallelism), "device_id", "page_id")
    base = views.selectExpr("device_id", "page_id", "log_tm", f"posexplode(array({', '.join(entries)})) AS (seq, entry)")
    return base.withColumn("seq", F.col("seq") + 1)


# The same frames as DuckDB common table expressions, for the check SQL.
CHECK_CTES = f"""
event_log AS (
  SELECT event_id, ts AS log_tm_dt, epoch_us(ts) // 1000 AS log_tm, CAST(ts AS DATE) AS log_date,
         'd' || user_id AS device_id,
         CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'u' || user_id END AS user_id,
         'pkg' || (user_id % 2) AS package_nm, CAST(0 AS BIGINT) AS server_type,
         CASE user_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' ELSE 'Web' END AS os_type,
         '1.' || (user_id % 4) AS app_ver, 'M' || (user_id % 20) AS device_model,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         'https://app/p' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12)
           || '?k=' || regexp_extract(props, '([0-9]+)', 1) AS req_url,
         CAST(CASE WHEN event_type = 'view' THEN 131073 WHEN event_type = 'click' THEN 131088
              WHEN event_type = 'signup' THEN 1048597 WHEN event_type = 'purchase' THEN 524291
              WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 = 0 THEN 2097152
              ELSE 131077 END AS BIGINT) AS log_type,
         CAST(floor(value * 50) AS BIGINT) AS intervaltime,
         CAST(CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5
              WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS BIGINT) AS status_code,
         event_type, value
  FROM events),
page_flow AS (
  SELECT log_date, log_tm AS page_start_tm, log_tm_dt AS page_start_tm_dt, log_tm + intervaltime AS page_end_tm,
         device_id, user_id, package_nm, server_type, os_type, app_ver, device_model, req_url,
         split_part(req_url, '?', 1) AS page_name, event_id AS page_id, log_type,
         CASE WHEN k % 7 = 0 THEN NULL ELSE intervaltime END AS intervaltime,
         CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS loading_time,
         CASE WHEN log_type = 524291 THEN intervaltime ELSE 0 END AS response_time,
         CASE WHEN log_type = 524291 THEN 1 ELSE 0 END AS request_count,
         CASE WHEN log_type = 131077 THEN 1 ELSE 0 END AS error_count,
         CASE WHEN log_type = 131077 AND k % 2 = 0 THEN 1 ELSE 0 END AS js_error_count,
         CASE WHEN log_type = 2097152 THEN 1 ELSE 0 END AS crash_count,
         1 AS event_count, 1 AS log_count, k AS sum_cpu_usage, k * 10 AS sum_mem_usage,
         CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(floor(value * 10) AS DOUBLE) END AS lcp,
         CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(floor(value * 4) AS DOUBLE) / 4 END AS inp,
         CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) / 1024 END AS cls,
         CAST(floor(value * 5) AS DOUBLE) AS fcp, CAST(floor(value * 2) AS DOUBLE) AS ttfb
  FROM event_log),
trouble_log AS (
  SELECT *, CASE WHEN log_type = 2097152 THEN 'C' ELSE 'E' END || (k % 10) AS log_name
  FROM event_log WHERE log_type IN (131077, 2097152)),
network_log AS (
  SELECT *, (status_code // 100) || 'xx' AS status_group FROM event_log WHERE log_type = 524291),
access_history AS (
  SELECT log_date, package_nm, server_type, os_type, device_id, count(*) AS visit_cnt,
         count(*) FILTER (log_type = 1048597) AS install_cnt, 0 AS login_cnt
  FROM event_log WHERE log_type IN (1048597, 131073) GROUP BY ALL),
vital_wide AS (
  SELECT page_start_tm AS log_tm, log_date, device_id, package_nm, server_type, os_type, page_name, page_id,
         lcp, inp, cls, fcp, ttfb FROM page_flow),
vital_rows AS (
  SELECT log_tm, log_date, device_id, package_nm, server_type, os_type, page_name, page_id, 'lcp' AS name, lcp AS value FROM vital_wide
  UNION ALL SELECT log_tm, log_date, device_id, package_nm, server_type, os_type, page_name, page_id, 'inp', inp FROM vital_wide
  UNION ALL SELECT log_tm, log_date, device_id, package_nm, server_type, os_type, page_name, page_id, 'cls', cls FROM vital_wide
  UNION ALL SELECT log_tm, log_date, device_id, package_nm, server_type, os_type, page_name, page_id, 'fcp', fcp FROM vital_wide
  UNION ALL SELECT log_tm, log_date, device_id, package_nm, server_type, os_type, page_name, page_id, 'ttfb', ttfb FROM vital_wide),
vital_log AS (
  SELECT *, CASE WHEN value < 100 THEN 'good' WHEN value < 500 THEN 'needs-improvement' ELSE 'poor' END AS rating
  FROM vital_rows WHERE value IS NOT NULL),
mkt_event AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, package_nm AS application_id, server_type,
         coalesce(user_id, '') AS user_id, device_id, coalesce(user_id, device_id) AS user_key,
         event_type AS event_name, log_tm_dt AS event_time, log_tm, os_type AS platform, app_ver AS app_version,
         device_model, k,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_first_open,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_important_event
  FROM event_log),
device_days AS (
  SELECT device_id, package_nm, server_type, os_type, device_model, min(log_date) AS created_date,
         max(log_date) AS last_date, max(CASE WHEN log_type = 1048597 THEN log_date END) AS last_install,
         count(*) FILTER (log_type = 1048597) AS installs, DATE '{AS_OF}' - max(log_date) AS idle
  FROM event_log GROUP BY ALL),
device_info AS (
  SELECT device_id, package_nm, server_type, os_type, device_model, created_date, last_date,
         CASE WHEN idle >= 1 THEN 'N' ELSE 'Y' END AS active_st,
         CASE WHEN idle >= 1 THEN 'S' WHEN installs > 12 THEN 'R' ELSE 'N' END AS device_st,
         CASE WHEN CAST(substr(device_id, 2) AS BIGINT) % 5 = 0 THEN 'Y' ELSE 'N' END AS vip_yn,
         CASE WHEN installs > 12 THEN last_install END AS reinstalled_date,
         CASE WHEN idle >= 1 THEN last_date + 1 END AS sleep_date,
         CASE WHEN idle >= 2 THEN last_date + 2 END AS deleted_date
  FROM device_days),
daily_access AS (
  SELECT *, log_date - created_date + 1 AS retention_day FROM (
    SELECT log_date, device_id, package_nm, server_type, os_type, app_ver, device_model, min(log_tm) AS app_start_tm,
           max(log_tm) - min(log_tm) AS using_time, CASE WHEN count(user_id) > 0 THEN 'Y' ELSE 'N' END AS login_yn,
           CASE WHEN bool_or(log_type = 1048597) THEN 'Y' ELSE 'N' END AS install_yn
    FROM event_log GROUP BY ALL) JOIN (SELECT device_id, created_date FROM device_days) USING (device_id))
"""
