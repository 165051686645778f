"""Decoding, routing, identity and traffic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import text
from tidemark.functions import timegrid as tg
from tidemark.operators import ingest
from tidemark.plans.registry import Tables, query, scratch
from tidemark.sources import decode, files
from tidemark.sources import driver_tables as dtb


def event_lines(t: Tables):
    """The driver's events written out as 42-field lines, the decoder's input."""
    fields = {
        1: "CAST(log_tm AS STRING)", 2: "device_id", 3: "CAST(log_type AS STRING)", 4: "CAST(k % 7 AS STRING)",
        5: "concat('os^', k, '|x')", 6: "app_ver", 7: "device_model", 8: "CAST(k * 10 AS STRING)",
        9: "IF(k % 9 = 0, 'bad', CAST(k AS STRING))", 12: "req_url", 13: "concat('msg ', event_type, '^ ', k, '|at f.js')",
        14: "CAST(intervaltime AS STRING)", 26: "package_nm", 27: "CAST(server_type AS STRING)", 28: "os_type",
        32: "coalesce(user_id, '')", 36: "IF(k % 4 = 0, '', CAST(status_code AS STRING))", 42: "CAST(event_id AS STRING)",
    }
    parts = ", ".join(fields.get(i, "''") for i in range(1, 43))
    return t.events.selectExpr(f"concat_ws(',', {parts}) AS value")


@query(
    "decode_events",
    """
    SELECT log_tm, device_id, log_type, CAST(k % 7 AS VARCHAR) AS com_type, 'os,' || k || chr(10) || 'x' AS os_ver,
           app_ver, CAST(k * 10 AS BIGINT) AS mem_usage, CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE k END AS BIGINT) AS cpu_usage,
           'msg ' || event_type || ', ' || k || chr(10) || 'at f.js' AS res_msg, intervaltime,
           CASE WHEN k % 4 = 0 THEN NULL ELSE status_code END AS status_code, CAST(event_id AS VARCHAR) AS page_id,
           split_part(req_url, '?', 1) AS url_path, split_part(req_url, '?', 2) AS url_query,
           CAST(log_date AS VARCHAR) AS log_date
    FROM event_log
    """,
)
def _(t: Tables):
    return decode.decode_events(event_lines(t)).select(
        "log_tm", "device_id", "log_type", "com_type", "os_ver", "app_ver", "mem_usage", "cpu_usage", "res_msg",
        "intervaltime", "status_code", "page_id", "url_path", "url_query", "log_date",
    )


@query(
    "decode_pages",
    """
    SELECT device_id, package_nm, server_type, os_type, page_start_tm, page_name, intervaltime, loading_time,
           CAST(sum_cpu_usage AS BIGINT) AS sum_cpu_usage, CAST(CASE WHEN page_id % 10 = 0 THEN 131073 ELSE log_type END AS BIGINT) AS log_type,
           CASE WHEN page_id % 10 = 0 THEN 'N' ELSE 'Y' END AS wtf_flag,
           CASE WHEN page_id % 10 = 0 THEN NULL ELSE round(lcp, 4) END AS lcp, CAST(log_date AS VARCHAR) AS log_date
    FROM page_flow
    """,
)
def _(t: Tables):
    fields = {
        1: "device_id", 2: "package_nm", 3: "CAST(server_type AS STRING)", 4: "os_type", 5: "app_ver", 8: "device_model",
        14: "req_url", 16: "CAST(page_start_tm AS STRING)", 20: "coalesce(CAST(intervaltime AS STRING), '')",
        21: "coalesce(CAST(loading_time AS STRING), 'x')", 46: "CAST(sum_cpu_usage AS STRING)",
        47: "CAST(sum_mem_usage AS STRING)", 49: "CAST(log_type AS STRING)", 50: "'Y'", 53: "coalesce(user_id, '')",
        54: "coalesce(CAST(cls AS STRING), '')", 55: "coalesce(CAST(inp AS STRING), '')",
        56: "coalesce(CAST(lcp AS STRING), '')", 59: "CAST(page_id AS STRING)",
    }
    short = ", ".join(fields.get(i, "''") for i in range(1, 49))
    full = ", ".join(fields.get(i, "''") for i in range(1, 60))
    lines = t.pages.selectExpr(f"IF(page_id % 10 = 0, concat_ws(',', {short}), concat_ws(',', {full})) AS value")
    return decode.decode_pages(lines).select(
        "device_id", "package_nm", "server_type", "os_type", "page_start_tm", "page_name", "intervaltime",
        "loading_time", "sum_cpu_usage", "log_type", "wtf_flag", F.round("lcp", 4).alias("lcp"), "log_date",
    )


def marketing_lines(t: Tables):
    token = decode.JSON_COMMA
    fields = {
        1: "CAST(log_tm AS STRING)", 2: "device_id", 6: "app_version", 7: "device_model", 12: "event_name",
        13: f"CASE CAST(event_id AS BIGINT) % 3 WHEN 0 THEN concat(' {{\"k\": 1{token} \"v\": 2}} ') WHEN 1 THEN 'oops' ELSE '' END",
        26: "application_id", 27: "CAST(server_type AS STRING)", 28: "platform", 32: "user_id",
        43: "CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN 'm.naver.com' WHEN 1 THEN 'blog.example' ELSE '' END",
        44: "CASE CAST(event_id AS BIGINT) % 5 WHEN 0 THEN 'mail' ELSE '' END",
        45: "CASE CAST(event_id AS BIGINT) % 7 WHEN 0 THEN 'cpc' ELSE '' END",
        47: "IF(CAST(event_id AS BIGINT) % 2 = 0, concat('\"', '00000000-0000-4000-8000-', lpad(event_id, 12, '0'), '\"'), '')",
        59: "CAST(is_first_open AS STRING)",
    }
    parts = ", ".join(fields.get(i, "''") for i in range(1, 60))
    return t.marketing.selectExpr(f"concat_ws(',', {parts}) AS value")


@query(
    "decode_marketing",
    """
    SELECT CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN '00000000-0000-4000-8000-' || lpad(event_id, 12, '0') END AS given_id,
           device_id, event_name, log_tm AS event_ms, platform,
           CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN '{"k": 1, "v": 2}' ELSE '{}' END AS event_params,
           CAST(is_first_open AS BIGINT) AS is_first_open
    FROM mkt_event
    """,
)
def _(t: Tables):
    rows = decode.decode_marketing(marketing_lines(t))
    return rows.select(
        F.when(F.col("event_id").startswith("00000000-0000-4000"), F.col("event_id")).alias("given_id"), "device_id",
        "event_name", F.unix_millis("event_time").alias("event_ms"), "platform", "event_params", "is_first_open",
    )


@query(
    "attribute_traffic",
    """
    SELECT log_tm AS event_ms, device_id,
           CASE WHEN platform = 'Web' THEN coalesce(nullif(src, ''), engine, nullif(dom, ''), 'direct') ELSE nullif(src, '') END AS traffic_source,
           CASE WHEN platform = 'Web' THEN CASE WHEN med <> '' THEN med WHEN engine IS NOT NULL THEN 'organic'
                WHEN dom <> '' THEN 'referral' ELSE 'none' END ELSE nullif(med, '') END AS medium
    FROM hits
    """,
    ctes="""
    hits AS (SELECT *, CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN 'm.naver.com' WHEN 1 THEN 'blog.example' ELSE '' END AS dom,
             CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN 'naver' END AS engine,
             CASE CAST(event_id AS BIGINT) % 5 WHEN 0 THEN 'mail' ELSE '' END AS src,
             CASE CAST(event_id AS BIGINT) % 7 WHEN 0 THEN 'cpc' ELSE '' END AS med FROM mkt_event)
    """,
)
def _(t: Tables):
    rows = ingest.attribute_traffic(decode.decode_marketing(marketing_lines(t)), t.engines)
    return rows.select(F.unix_millis("event_time").alias("event_ms"), "device_id", "traffic_source", "medium")


@query(
    "explode_packets",
    """
    SELECT device_id, log_tm, 'pkg' || (CAST(substr(device_id, 2) AS BIGINT) % 2) AS package_id, 0 AS server_type FROM event_log
    """,
)
def _(t: Tables):
    lines = t.events.select(
        F.concat_ws("^", F.lit("a"), F.lit("b"), F.col("server_type").cast("string"), F.upper("package_nm")).alias("key"),
        F.concat_ws(",", "device_id", F.col("log_tm").cast("string")).alias("line"), F.floor(F.col("event_id") / 10).alias("part"),
    )
    # At most ten lines to a packet.
    packets = lines.groupBy("key", "part").agg(F.concat_ws("\n", F.collect_list("line")).alias("value"))
    rows = decode.explode_packets(packets.select("key", "value"))
    parts = F.split("value", ",")
    return rows.select(
        parts[0].alias("device_id"), parts[1].cast("long").alias("log_tm"), "package_id", "server_type"
    )


@query(
    "filter_clock_skew",
    """
    SELECT anomaly, count(*) AS cnt, count(*) FILTER (log_tm < epoch_ms(TIMESTAMP '2024-01-20 00:00:00') + 180000) AS kept
    FROM (SELECT *, CASE WHEN k % 10 = 0 THEN 'nn' ELSE 'n' END AS anomaly FROM event_log) GROUP BY 1
    """,
)
def _(t: Tables):
    arrived = t.events.withColumn("timestamp", F.when(F.col("k") % 10 == 0, F.expr("log_tm_dt - INTERVAL 200 SECONDS")).otherwise(F.col("log_tm_dt")))
    tagged = ingest.tag_clock_skew(arrived)
    kept = ingest.filter_clock_skew(tagged, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    both = tagged.groupBy("anomaly").agg(F.count(F.lit(1)).alias("cnt"))
    return both.join(kept.groupBy("anomaly").agg(F.count(F.lit(1)).alias("kept")), "anomaly", "left")


@query(
    "route_by_type",
    """
    SELECT s.stream, count(*) AS cnt, CAST(sum(log_tm % 1000) AS BIGINT) AS ms_sum
    FROM event_log e JOIN (VALUES ('crash', 2097152), ('error', 131077), ('network', 524291), ('page', 131073), ('access', 131073), ('native', 2097152)) s(stream, code)
      ON e.log_type = s.code GROUP BY 1
    """,
)
def _(t: Tables):
    tagged = ingest.tag_streams(t.events)
    names = [c for c in tagged.columns if c.startswith("is_")]
    hits = F.filter(F.array(*[F.when(F.col(c), F.lit(c[3:])) for c in names]), lambda x: x.isNotNull())
    return tagged.select("log_tm", F.explode(hits).alias("stream")).groupBy("stream").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.col("log_tm") % 1000).alias("ms_sum")
    )


@query(
    "derive_trouble",
    """
    SELECT log_name, log_type, count(*) AS cnt, count(DISTINCT device_id) AS devices FROM (
      SELECT *, CASE WHEN k % 6 = 0 THEN NULL ELSE 'e' || (k % 10) END AS log_name FROM event_log WHERE log_type IN (2097152, 131077))
    GROUP BY 1, 2
    """,
)
def _(t: Tables):
    message = F.when(F.col("k") % 6 == 0, "").otherwise(F.concat(F.lit("e"), (F.col("k") % 10).cast("string"), F.lit("\r\nat a.js:1:2")))
    trouble = ingest.derive_trouble(t.events.withColumn("res_msg", message))
    return trouble.groupBy("log_name", "log_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_distinct("device_id").alias("devices")
    )


@query(
    "url_split",
    """
    SELECT page_id, split_part(url, '?', 1) AS url_path, split_part(url, '?', 2) AS url_query FROM pages
    """,
)
def _(t: Tables):
    return decode.with_url_parts(t.raw("pages"), "url").select("page_id", "url_path", "url_query")


@query(
    "url_sub_key",
    """
    SELECT page_id, CASE WHEN url NOT LIKE '%?%' OR NOT (k = 'http-en') THEN k
      ELSE k || '?' || coalesce((SELECT string_agg(split_part(p, '=', 1) || '=' || split_part(p, '=', 2), '&' ORDER BY i)
        FROM (SELECT unnest(string_split(q, '&')) AS p, generate_subscripts(string_split(q, '&'), 1) AS i) WHERE split_part(p, '=', 1) = 'page'), '') END AS url_sub_key
    FROM (SELECT page_id, url, split_part(url, '?', 2) AS q,
      CASE WHEN regexp_matches(split_part(url, '?', 1), '^https?://[^/]+/en/') THEN 'http-en'
           WHEN regexp_matches(split_part(url, '?', 1), '^https?://m[.]') THEN 'mobile' ELSE split_part(url, '?', 1) END AS k FROM pages)
    """,
)
def _(t: Tables):
    rules = [(r"https?://[^/]+/en/", "http-en"), (r"https?://m[.]", "mobile")]
    return ingest.url_sub_key(t.raw("pages"), "url", rules, {"http-en": ["page"]}).select("page_id", "url_sub_key")


# CRC-32 a byte at a time: eight shifts, with the reversed polynomial where the low bit is set.
_CRC32 = """
xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)
"""


@query(
    "hash_key",
    f"""
    SELECT device_id, format('{{:08x}}', {_CRC32.format("device_id")}) AS hash32, 16 AS width64, CAST(NULL AS VARCHAR) AS blank, cnt FROM (SELECT device_id, count(*) AS cnt FROM event_log GROUP BY 1)
    """,
)
def _(t: Tables):
    counts = t.events.groupBy("device_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(
        "device_id", text.hash_key("device_id", "32").alias("hash32"), F.length(text.hash_key("device_id")).alias("width64"), text.hash_key(F.lit("  ")).alias("blank"), "cnt",
    )


@query("decrypt_lines", "SELECT event_id, event_id || ',' || device_id || ',' || log_tm AS line FROM event_log")
def _(t: Tables):
    """Every other line comes encrypted, with its own leading vector."""
    key = "0123456789abcdef"
    line = F.concat_ws(",", "event_id", "device_id", "log_tm")
    vector = F.unhex(F.substring(F.md5(F.col("event_id").cast("string")), 1, 32))
    secret = F.base64(F.aes_encrypt(line, F.lit(key.encode()), F.lit("CBC"), F.lit("PKCS"), vector))
    sent = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, line).otherwise(secret).alias("line"))
    return decode.decrypt_lines(sent, "line", key)


@query(
    "normalise_network",
    """
    SELECT CASE k % 7 WHEN 1 THEN 'WiFi' WHEN 2 THEN '2G' WHEN 3 THEN '3G' WHEN 4 THEN 'LTE' WHEN 5 THEN '5G' ELSE 'ETC' END AS network,
           count(*) AS cnt FROM event_log GROUP BY 1
    """,
)
def _(t: Tables):
    return t.events.groupBy(text.normalise_network(F.col("k") % 7).alias("network")).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "dedup_latest",
    """
    SELECT device_id, app_ver, log_tm, event_id, intervaltime FROM event_log
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY log_tm DESC, event_id DESC) = 1
    """,
)
def _(t: Tables):
    rows = t.events.select("device_id", "app_ver", "log_tm", "event_id", "intervaltime")
    return ingest.dedup_latest(rows, ["device_id"], "log_tm", ["event_id"])


@query("apply_retention", "SELECT event_id, log_tm FROM event_log WHERE log_date >= DATE '2024-01-26'")
def _(t: Tables):
    return files.apply_retention(t.events, "log_date", 4, dtb.AS_OF).select("event_id", "log_tm")


IDENTITY_CTE = """
identity AS (SELECT device_id, arg_max(user_id, (log_tm, user_id)) AS mapped FROM event_log
             WHERE user_id IS NOT NULL AND event_type = 'purchase' GROUP BY 1)
"""


def _identity(t: Tables):
    known = t.events.filter("user_id IS NOT NULL AND event_type = 'purchase'")
    return known.select("device_id", "user_id", F.col("log_tm_dt").alias("updated_at"))


@query(
    "stitch_identity",
    "SELECT event_id, coalesce(mapped, device_id) AS user_key FROM event_log LEFT JOIN identity USING (device_id)",
    ctes=IDENTITY_CTE,
)
def _(t: Tables):
    return ingest.stitch_identity(t.events, _identity(t)).select("event_id", "user_key")


@query(
    "stitch_identity_own_first",
    "SELECT event_id, coalesce(mapped, user_id, device_id) AS user_key FROM event_log LEFT JOIN identity USING (device_id)",
    ctes=IDENTITY_CTE,
)
def _(t: Tables):
    return ingest.stitch_identity(t.events, _identity(t), own_first=True).select("event_id", "user_key")


@query(
    "backfill_identity",
    "SELECT event_id, coalesce(mapped, user_key) AS user_key FROM mkt_event LEFT JOIN identity USING (device_id)",
    ctes=IDENTITY_CTE,
)
def _(t: Tables):
    return ingest.backfill_identity(t.marketing, _identity(t)).select(F.col("event_id"), "user_key")


STORED = ["event_id", "device_id", "log_tm", "intervaltime", "package_nm", "server_type", "log_date"]


@query(
    "scan_range",
    "SELECT CAST(log_date AS VARCHAR) AS log_date, count(*) AS cnt, CAST(sum(intervaltime) AS BIGINT) AS total FROM event_log WHERE log_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY 1",
)
def _(t: Tables):
    """Events written by day and read back for a range of days."""
    rows, place = t.events.select(*STORED), scratch(t.spark, "scan_range")
    files.write_partitioned(rows, place)
    found = files.scan_range(t.spark, place, rows.schema, dt.date(2024, 1, 10), dt.date(2024, 1, 16))
    return found.groupBy("log_date").agg(F.count(F.lit(1)).alias("cnt"), F.sum("intervaltime").alias("total"))


@query(
    "settle_batches",
    """
    SELECT event_id, intervaltime + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS intervaltime, CAST(log_date AS VARCHAR) AS log_date,
           CASE WHEN log_date = DATE '2024-01-10' THEN 'settled' ELSE 'batches' END AS place FROM event_log
    """,
)
def _(t: Tables):
    """Two micro-batches, the second with newer rows of half the keys and one of them written twice; a closed day is compacted."""
    rows, place = t.events.select(*STORED), scratch(t.spark, "settle")
    newer = rows.filter("event_id % 2 = 0").withColumn("intervaltime", F.col("intervaltime") + 1)
    for batch_id, batch in ((1, rows), (2, newer), (2, newer)):
        files.write_batch(batch, f"{place}/batches", batch_id)
    for _ in range(2):
        files.compact(t.spark, f"{place}/batches", f"{place}/settled", rows.schema, ["event_id"], dt.date(2024, 1, 10))
    settled = files.scan_range(t.spark, f"{place}/settled", rows.schema, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).withColumn("place", F.lit("settled"))
    left = files.read_latest(t.spark, f"{place}/batches", rows.schema, ["event_id"]).withColumn("place", F.lit("batches"))
    return settled.unionByName(left).select("event_id", "intervaltime", "log_date", "place")


@query("latest_trouble_types", "SELECT log_type, count(*) AS cnt FROM event_log WHERE log_type IN (2097152, 131077) GROUP BY 1")
def _(t: Tables):
    return t.events.filter(F.col("log_type").isin(*lt.TROUBLE)).groupBy("log_type").agg(F.count(F.lit(1)).alias("cnt"))
