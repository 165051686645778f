"""Declared table schemas. Sources never infer a schema.

Table and column names are fixed values: data written by the existing collectors uses them.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "date": T.DateType(),
}


def _struct(text: str) -> T.StructType:
    """Fields from ``name type`` pairs; needs no session, so schemas can be module constants."""
    pairs = [pair.split() for pair in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENT_LOG = _struct(
    """
    reg_dt timestamp, log_tm bigint, device_id string, log_type bigint, com_type string, os_ver string,
    app_ver string, device_model string, mem_usage bigint, cpu_usage bigint, com_sensitivity string,
    battery_lvl string, req_url string, res_msg string, intervaltime bigint, storage_usage bigint,
    storage_total bigint, timezone string, webview_ver string, app_build_num string, referer string,
    ip string, sim_operator_nm string, login_yn string, session_id string, web_only_yn string,
    package_nm string, server_type bigint, os_type string, deep_link string, page_url string,
    jennifer_data string, user_id string, optional string, os_lang string, webview_size string,
    status_code bigint, response_size bigint, request_size bigint, wait_time bigint,
    download_time bigint, req_msg string, page_id string, log_tm_dt timestamp, log_date date,
    url_path string, url_query string
    """
)

PAGE_FLOW = _struct(
    """
    reg_dt timestamp, device_id string, package_nm string, server_type bigint, os_type string,
    app_ver string, os_ver string, app_build_num string, device_model string, sim_operator_nm string,
    com_type string, timezone string, vip_yn string, login_yn string, req_url string, flow_order bigint,
    page_start_tm bigint, page_end_tm bigint, parent_log_date bigint, event_intervaltime bigint,
    intervaltime bigint, loading_time bigint, response_time bigint, request_count bigint,
    event_count bigint, error_count bigint, js_error_count bigint, crash_count bigint, log_count bigint,
    avg_battery_lvl bigint, avg_com_sensitivity bigint, avg_cpu_usage bigint, avg_mem_usage bigint,
    avg_storage_usage bigint, max_battery_lvl bigint, max_com_sensitivity bigint, max_cpu_usage bigint,
    max_mem_usage bigint, max_storage_usage bigint, min_battery_lvl bigint, min_com_sensitivity bigint,
    min_cpu_usage bigint, min_mem_usage bigint, min_storage_usage bigint, sum_battery_lvl bigint,
    sum_com_sensitivity bigint, sum_cpu_usage bigint, sum_mem_usage bigint, sum_storage_usage bigint,
    log_type bigint, wtf_flag string, pre_url string, pre_url_time bigint, user_id string, cls double,
    inp double, lcp double, fcp double, ttfb double, page_id string, page_start_tm_dt timestamp,
    page_name string, log_date date
    """
)

MKT_EVENT = _struct(
    """
    event_id string, application_id string, server_type bigint, user_id string, device_id string,
    user_key string, session_id string, event_name string, event_time timestamp, platform string,
    os_category string, app_version string, os_version string, device_category string,
    device_model string, browser string, geo_country string, geo_region string, geo_city string,
    traffic_source string, medium string, campaign string, sex string, age string, event_params string,
    user_properties string, is_important_event bigint, is_first_install bigint, is_first_open bigint
    """
)

PACKET = _struct("key string, value string, timestamp timestamp")

WEBPERF_LOG = _struct(
    """
    reg_dt timestamp, log_tm bigint, device_id string, log_type bigint, page_id bigint, os_type string,
    package_nm string, res_msg string, server_type bigint, log_tm_dt timestamp
    """
)

IDENTITY = _struct("device_id string, user_id string, updated_at timestamp")
SEARCH_ENGINE = _struct("domain string, engine_name string")

ACCESS_HISTORY = _struct(
    """
    log_date date, package_nm string, server_type bigint, os_type string, device_id string,
    visit_cnt bigint, install_cnt bigint, login_cnt bigint
    """
)

DEVICE_STATISTIC = _struct(
    """
    stat_date date, package_nm string, server_type bigint, os_type string, visit bigint, install bigint,
    login bigint, dau bigint, revisit_7d bigint, mau bigint, crash_count bigint, error_count bigint,
    js_error_count bigint, log_count bigint, intervaltime_avg double, lcp_avg double, ttfb_avg double,
    fcp_avg double, inp_avg double, pv bigint, updated_at timestamp
    """
)

# Days each table is kept (fixed values).
RETENTION_DAYS = {
    "event_log": 4,
    "trouble_log": 180,
    "page_flow": 93,
    "page_daily": 365,
    "model_hourly": 365,
    "access_history": 365,
    "access_bitmap": 365,
}

# Replacing keys of each table, newest version wins (fixed values).
REPLACING_KEYS = {
    "event_log": (("log_tm", "device_id", "mem_usage"), "reg_dt"),
    "page_flow": (("page_start_tm", "device_id", "sum_mem_usage"), "reg_dt"),
    "user_identity": (("device_id",), "updated_at"),
    "device_statistic": (("stat_date", "package_nm", "server_type", "os_type"), "updated_at"),
    "mkt_event": (("event_id",), "version"),
}
