"""Comma-line decoders: event lines, page lines, marketing lines, packets and payloads.

A line is split once and read by position. The layouts are fixed values of the collectors' format.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timegrid as tg
from tidemark.functions import text

# Position (from 1), column, kind. Kinds: text, esc (escaped text), zero (bad number -> 0), null (bad number -> NULL).
EVENT_FIELDS = (
    (1, "log_tm", "zero"), (2, "device_id", "text"), (3, "log_type", "zero"), (4, "com_type", "text"),
    (5, "os_ver", "esc"), (6, "app_ver", "esc"), (7, "device_model", "esc"), (8, "mem_usage", "zero"),
    (9, "cpu_usage", "zero"), (10, "com_sensitivity", "text"), (11, "battery_lvl", "text"), (12, "req_url", "text"),
    (13, "res_msg", "esc"), (14, "intervaltime", "zero"), (15, "storage_usage", "zero"), (16, "storage_total", "zero"),
    (17, "timezone", "text"), (18, "webview_ver", "text"), (19, "app_build_num", "text"), (20, "referer", "text"),
    (21, "ip", "text"), (22, "sim_operator_nm", "text"), (23, "login_yn", "text"), (24, "session_id", "text"),
    (25, "web_only_yn", "text"), (26, "package_nm", "text"), (27, "server_type", "zero"), (28, "os_type", "text"),
    (29, "deep_link", "text"), (30, "page_url", "text"), (31, "jennifer_data", "text"), (32, "user_id", "text"),
    (33, "optional", "text"), (34, "os_lang", "text"), (35, "webview_size", "text"), (36, "status_code", "null"),
    (37, "response_size", "null"), (38, "request_size", "null"), (39, "wait_time", "null"),
    (40, "download_time", "null"), (41, "req_msg", "esc"), (42, "page_id", "text"),
)

_STATS = ("battery_lvl", "com_sensitivity", "cpu_usage", "mem_usage", "storage_usage")
PAGE_FIELDS = (
    (1, "device_id", "text"), (2, "package_nm", "text"), (3, "server_type", "zero"), (4, "os_type", "text"),
    (5, "app_ver", "esc"), (6, "os_ver", "esc"), (7, "app_build_num", "esc"), (8, "device_model", "esc"),
    (9, "sim_operator_nm", "text"), (10, "com_type", "text"), (11, "timezone", "text"), (12, "vip_yn", "text"),
    (13, "login_yn", "text"), (14, "req_url", "text"), (15, "flow_order", "null"), (16, "page_start_tm", "null"),
    (17, "page_end_tm", "null"), (18, "parent_log_date", "null"), (19, "event_intervaltime", "null"),
    (20, "intervaltime", "null"), (21, "loading_time", "null"), (22, "response_time", "null"),
    (23, "request_count", "null"), (24, "event_count", "null"), (25, "error_count", "null"),
    (26, "js_error_count", "null"), (27, "crash_count", "null"), (28, "log_count", "null"),
    *[(29 + 5 * i + j, f"{kind}_{stat}", "null") for i, kind in enumerate(("avg", "max", "min", "sum")) for j, stat in enumerate(_STATS)],
    (49, "log_type", "null"), (50, "wtf_flag", "text"), (51, "pre_url", "text"), (52, "pre_url_time", "null"),
    (53, "user_id", "text"), (54, "cls", "float"), (55, "inp", "float"), (56, "lcp", "float"), (57, "fcp", "float"),
    (58, "ttfb", "float"), (59, "page_id", "text"),
)
# Values taken by short page lines.
PAGE_DEFAULTS = {"log_type": 131073, "wtf_flag": "N"}

MARKETING_FIELDS = (
    (26, "application_id", "text"), (27, "server_type", "null"), (32, "user_id", "text"), (2, "device_id", "text"),
    (24, "session_id", "text"), (12, "event_name", "text"), (28, "platform", "text"), (49, "os_category", "text"),
    (6, "app_version", "text"), (5, "os_version", "text"), (48, "device_category", "text"),
    (7, "device_model", "text"), (50, "browser", "text"), (53, "geo_country", "text"), (54, "geo_region", "text"),
    (55, "geo_city", "text"), (43, "referrer_domain", "text"), (44, "source", "text"), (45, "explicit_medium", "text"),
    (46, "campaign", "text"), (51, "sex", "text"), (52, "age", "text"), (57, "is_important_event", "null"),
    (58, "is_first_install", "null"), (59, "is_first_open", "null"),
)
# Stands for a comma inside the JSON fields of a marketing line (fixed value).
JSON_COMMA = "clickhousecomma"



def _item(arr: Column, position: int) -> Column:
    return F.coalesce(F.get(arr, F.lit(position - 1)), F.lit(""))


def unescape(value: Column) -> Column:
    """``^`` back to a comma and ``|`` back to a line break."""
    return F.translate(value, "^|", ",\n")


def _number(value: Column) -> Column:
    """Unsigned whole number or NULL; signs, blanks and fractions are not numbers."""
    return F.when(value.rlike(r"^[0-9]+$"), value).try_cast("bigint")


def _read(arr: Column, position: int, kind: str) -> Column:
    value = _item(arr, position)
    if kind == "esc":
        return unescape(value)
    if kind == "zero":
        return F.coalesce(_number(value), F.lit(0).cast("bigint"))
    if kind == "null":
        return _number(value)
    if kind == "float":
        return value.try_cast("double")
    return value


def _split(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_arr", F.split(F.col(col), ",", -1))


def _columns(fields) -> list[Column]:
    return [_read(F.col("_arr"), position, kind).alias(name) for position, name, kind in fields]


def _kept(df: DataFrame, col: str) -> list[str]:
    """Columns of the raw frame that ride along, such as the arrival time."""
    return [c for c in df.columns if c not in (col, "_arr")]


def decode_events(df: DataFrame, col: str = "value") -> DataFrame:
    """42-field line to event_log. Columns beside the line (``reg_dt``) are kept."""
    parsed = _split(df, col).select(*_kept(df, col), *_columns(EVENT_FIELDS))
    moment = F.timestamp_millis(F.col("log_tm"))
    return with_url_parts(
        parsed.withColumn("log_tm_dt", moment).withColumn("log_date", tg.utc_day("log_tm_dt")), "req_url"
    )


def decode_pages(df: DataFrame, col: str = "value") -> DataFrame:
    """59-field line to page_flow; fields a short line lacks take the defaults."""
    split = _split(df, col)
    parsed = split.select(F.size("_arr").alias("_n"), *_kept(df, col), *_columns(PAGE_FIELDS))
    for position, name, _ in PAGE_FIELDS:
        if name in PAGE_DEFAULTS:
            value = F.when(F.col("_n") >= position, F.col(name)).otherwise(F.lit(PAGE_DEFAULTS[name]))
            parsed = parsed.withColumn(name, value)
    return (
        parsed.drop("_n")
        .withColumn("sum_mem_usage", F.coalesce("sum_mem_usage", F.lit(0).cast("bigint")))
        .withColumn("page_start_tm_dt", F.timestamp_millis(F.col("page_start_tm")))
        .withColumn("page_name", text.url_path("req_url"))
        .withColumn("log_date", tg.utc_day("page_start_tm_dt"))
    )


def json_text(value: Column) -> Column:
    """Unescaped JSON text when it starts like an object or array, else ``{}``."""
    body = F.trim(F.replace(value, F.lit(JSON_COMMA), F.lit(",")))
    return F.when(body.startswith("{") | body.startswith("["), body).otherwise(F.lit("{}"))


_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def decode_marketing(df: DataFrame, col: str = "value") -> DataFrame:
    """59-field line to mkt_event, without identity and traffic, which S20 and S22 add.

    A line without an id gets one derived from its text, so a replay of the line gets the same id.
    """
    given = F.lower(F.trim(_item(F.col("_arr"), 47), F.lit('" ')))
    digest = F.md5(F.col(col))
    derived = F.concat_ws(
        "-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    return _split(df, col).select(
        *_kept(df, col),
        F.when(given.rlike(_UUID), given).otherwise(derived).alias("event_id"),
        F.timestamp_millis(_number(_item(F.col("_arr"), 1))).alias("event_time"),
        *_columns(MARKETING_FIELDS),
        json_text(_item(F.col("_arr"), 13)).alias("event_params"),
        json_text(_item(F.col("_arr"), 56)).alias("user_properties"),
    )


def with_variants(rows: DataFrame, cols: Sequence[str] = ("event_params", "user_properties")) -> DataFrame:
    """JSON text columns as variants, parsed once a row; text that is no JSON becomes NULL. Written tables keep them as they are."""
    return rows.withColumns({c: F.try_parse_json(c) for c in cols})


def with_url_parts(df: DataFrame, col: str, path: str = "url_path", query: str = "url_query") -> DataFrame:
    """Add the path before ``?`` and the query after it."""
    return df.withColumn(path, text.url_path(col)).withColumn(query, text.url_query(col))


def explode_packets(df: DataFrame) -> DataFrame:
    """One message of many lines to one row per line, with server type and package from its key."""
    key = F.split(F.col("key").cast("string"), r"\^")
    lines = F.split(F.col("value").cast("string"), "\n")
    kept = [c for c in df.columns if c not in ("key", "value")]
    return df.select(
        *kept,
        F.get(key, F.lit(2)).try_cast("int").alias("server_type"),
        F.lower(F.get(key, F.lit(3))).alias("package_id"),
        F.explode(lines).alias("value"),
    )


def decrypt_lines(df: DataFrame, col: str, key: str | bytes) -> DataFrame:
    """Lines without a comma are AES-128-CBC text with a leading IV; others pass through."""
    secret = key.encode() if isinstance(key, str) else key
    if len(secret) != 16:
        raise ValueError("the payload key must have 16 bytes")
    value = F.col(col)
    plain = F.try_aes_decrypt(F.try_to_binary(value, F.lit("base64")), F.lit(secret), F.lit("CBC"), F.lit("PKCS"))
    return df.withColumn(col, F.when(value.contains(","), value).otherwise(plain.cast("string")))
