"""Decoders on hand-made lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ingest
from tidemark.sources import decode


def line(fields, n):
    return ",".join(str(fields.get(i, "")) for i in range(1, n + 1))


def frame(spark, *lines):
    return spark.createDataFrame([(text,) for text in lines], "value string")


FULL = {1: 1704067200123, 2: "d1", 3: 131073, 5: "13^1|x", 8: 5, 9: 7, 12: "https://a/b?x=1&y=2", 13: "a^b|c", 26: "pkg", 27: 0, 36: 200, 42: "p1"}


def test_event_line(spark):
    r = decode.decode_events(frame(spark, line(FULL, 42))).first()
    assert (r.log_tm, r.device_id, r.log_type, r.os_ver, r.res_msg) == (1704067200123, "d1", 131073, "13,1\nx", "a,b\nc")
    assert (r.url_path, r.url_query, r.status_code, r.log_date) == ("https://a/b", "x=1&y=2", 200, dt.date(2024, 1, 1))
    assert {f.name for f in schemas.EVENT_LOG} - {"reg_dt"} == set(r.asDict())


def test_bad_numbers(spark):
    bad = FULL | {1: "x", 8: "-3", 9: "1.5", 27: "", 36: "oops", 37: "9"}
    r = decode.decode_events(frame(spark, line(bad, 42))).first()
    assert (r.log_tm, r.mem_usage, r.cpu_usage, r.server_type, r.status_code, r.response_size) == (0, 0, 0, 0, None, 9)


def test_short_event_line(spark):
    r = decode.decode_events(frame(spark, "1704067200000,d9,131077")).first()
    assert (r.device_id, r.log_type, r.req_url, r.status_code, r.page_id, r.url_query) == ("d9", 131077, "", None, "", "")


def test_page_line_defaults(spark):
    fields = {1: "d1", 2: "pkg", 3: "z", 14: "https://a/b?c", 16: 1704067200000, 46: 7, 47: "bad"}
    short, full = decode.decode_pages(frame(spark, line(fields, 48), line(fields | {49: 5, 50: "Y", 54: "0.25", 59: "p"}, 59))).collect()
    assert (short.log_type, short.wtf_flag, short.sum_cpu_usage, short.sum_mem_usage, short.server_type) == (131073, "N", 7, 0, 0)
    assert (full.log_type, full.wtf_flag, full.cls, full.page_id, full.page_name) == (5, "Y", 0.25, "p", "https://a/b")
    assert {f.name for f in schemas.PAGE_FLOW} - {"reg_dt"} == set(full.asDict())


def test_marketing_ids_and_json(spark):
    uid = "0195e3a1-0000-7000-8000-00000000000A"
    base = {1: 1704067200000, 2: "d1", 12: "view", 28: "Web"}
    lines = [
        line(base | {47: f' "{uid}" ', 13: '{"a":1clickhousecomma"b":2}'}, 59),
        line(base | {47: "nope", 13: "not json", 56: "[1]"}, 59),
    ]
    a, b = decode.decode_marketing(frame(spark, *lines)).collect()
    again = decode.decode_marketing(frame(spark, lines[1])).first()
    assert a.event_id == uid.lower() and a.event_params == '{"a":1,"b":2}'
    assert b.event_params == "{}" and b.user_properties == "[1]" and b.event_id == again.event_id != a.event_id


def test_packets(spark):
    df = spark.createDataFrame([("a^b^3^PKG", "l1\nl2", 1), ("x", "l3", 2)], "key string, value string, timestamp int")
    rows = sorted(tuple(r) for r in decode.explode_packets(df).select("value", "server_type", "package_id").collect())
    assert rows == [("l1", 3, "pkg"), ("l2", 3, "pkg"), ("l3", None, None)]


def test_decrypt(spark):
    key = "0123456789abcdef"
    df = spark.createDataFrame([("1,d1,131073",)], "value string")
    hidden = df.select(F.base64(F.aes_encrypt("value", F.lit(key.encode()), F.lit("CBC"))).alias("value"))
    rows = decode.decrypt_lines(df.unionByName(hidden), "value", key).collect()
    assert [r.value for r in rows] == ["1,d1,131073"] * 2
    with pytest.raises(ValueError):
        decode.decrypt_lines(df, "value", "short")


def test_clock_skew(spark):
    now = dt.datetime(2024, 1, 1)
    ms = 1704067200000
    df = spark.createDataFrame([(ms + 180_000, now), (ms + 181_000, now), (ms - 9_000_000, now)], "log_tm long, timestamp timestamp")
    df = df.withColumn("timestamp", F.timestamp_millis(F.lit(ms)))
    tags = [r.anomaly for r in ingest.tag_clock_skew(df).orderBy("log_tm").collect()]
    assert tags == ["n", "n", "nn"]
    df = df.withColumns({"server_type": F.lit(0), "package_nm": F.lit("p"), "log_date": F.lit(now.date())})
    assert ingest.filter_clock_skew(df, F.timestamp_millis(F.lit(ms))).count() == 1
    assert ingest.filter_clock_skew(df.withColumn("package_nm", F.lit(None).cast("string")), F.timestamp_millis(F.lit(ms))).count() == 0


def test_identity_order(spark):
    events = spark.createDataFrame([("d1", "own"), ("d2", "own"), (None, "own"), ("d3", "")], "device_id string, user_id string")
    known = spark.createDataFrame([("d1", "old", 1), ("d1", "new", 2), ("d3", "", 3)], "device_id string, user_id string, updated_at int")
    got = {r.device_id: r.user_key for r in ingest.stitch_identity(events, known).collect()}
    assert got == {"d1": "new", "d2": "d2", None: "own", "d3": "d3"}
    got = {r.device_id: r.user_key for r in ingest.stitch_identity(events, known, own_first=True).collect()}
    assert got == {"d1": "new", "d2": "own", None: "own", "d3": "d3"}


def test_dedup_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 2, "w")], "k string, v int, c string")
    got = {r.k: r.c for r in ingest.dedup_latest(df, ["k"], "v", ["c"]).collect()}
    assert got == {"a": "y", "b": "z"}


def test_url_keys(spark):
    df = spark.createDataFrame(
        [("http://a/course/7?id=1&x=2&id=3",), ("http://a/course/7",), ("http://a/other?id=1",), (None,), ("",)], "url string"
    )
    rules = [(r"http://a/course/\d+", "course"), (r"http://a/", "never-first")]
    got = [r.url_sub_key for r in ingest.url_sub_key(df, "url", rules, {"course": ["id"]}).collect()]
    assert got == ["course?id=1&id=3", "course", "never-first", "", ""]


def test_routes(spark):
    df = spark.createDataFrame([(131079,), (131073,), (None,)], "log_type long")
    routed = ingest.route_by_type(df)
    assert (routed["waterfall"].count(), routed["events"].count()) == (1, 2)
