"""Audiences and funnels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import conditions, funnel
from tidemark.plans.registry import Tables, query
from tidemark.sources import decode

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
START, END = dt.datetime(2024, 1, 8, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
_PERIOD = "event_time >= TIMESTAMP '2024-01-08' AND event_time < TIMESTAMP '2024-01-21'"


def event(name: str, **more):
    return {"categoryId": 9, "fieldId": 91, "field": name, **more}


def step(name: str) -> dict:
    return {"condition": [{"conditions": [event(name)]}]}


STEPS = [step("view"), step("click"), step("purchase")]
# A day, since the driver's events are sparse.
WINDOW_S = 86_400
CONDITION = [
    {"conditions": [{"fieldId": 21, "operator": 5, "value": "Android"}, {"fieldId": 24, "operator": 2, "value": "1.3"}]},
    {"conditions": [{"fieldId": 61, "operator": 5, "value": ["purchase", "click", " "]}]},
    {"conditions": [event("purchase", type="count", operator=8, value="6")]},
]
GROUPS = [
    {"name": "ALL"},
    {"name": "Android", "condition": [{"conditions": [{"fieldId": 21, "operator": 5, "value": "Android"}]}]},
    {"name": "Buyers", "condition": [{"conditions": [event("purchase", type="count", operator=6, value=14)]}]},
    {"name": "Nobody", "condition": [{"conditions": [{"fieldId": 21, "operator": 5, "value": "None such"}]}]},
    # A second group of one name.
    {"name": "Android", "condition": [{"conditions": [{"fieldId": 21, "operator": 5, "value": ["iOS", "Web"]}]}]},
]


@query(
    "condition_where",
    """
    SELECT platform, event_name, count(*) AS cnt FROM mkt_event WHERE (platform = 'Android' OR app_version LIKE '1.3%') AND event_name IN ('purchase', 'click') GROUP BY 1, 2
    """,
)
def _(t: Tables):
    pred = conditions.build_predicate(CONDITION, AS_OF)
    return t.marketing.filter(pred.where).groupBy("platform", "event_name").agg(F.count(F.lit(1)).alias("cnt"))


_PAGE = "event_name = 'view' AND"


CONDITION_FLAGS = f"""
    SELECT regexp_matches(device_model, 'M1[0-5]') AS by_regex, starts_with(device_model, 'M1') AS by_start, ends_with(device_id, '7') AS by_end, contains(lower(platform), 'roi') AS by_part,
           app_version > '1.2' AS by_more, app_version < '1.2' AS by_less, app_version >= '1.2' AS by_order, app_version <= '1.2' AS by_most, is_first_open = 1 AS by_flag, user_id <> '' AS by_login,
           k = 5 AS by_key, k IN (5, 7, 50) AS by_list, {_PAGE} 'p' || (k % 12) IN ('p3', 'p4') AS by_page, {_PAGE} '/p' || (k % 12) || '?k=' || k = '/p3?k=3' AS by_path,
           {_PAGE} k >= 0 AS by_host, count(*) AS cnt FROM mkt_event GROUP BY ALL
"""


@query("condition_operators", CONDITION_FLAGS)
def _(t: Tables):
    return condition_flags(t, parsed=False)


def condition_flags(t: Tables, parsed: bool):
    """How rows meet each kind of condition, read from JSON text or from variants parsed before."""
    rows = {
        "by_regex": {"field": "model", "operator": 1, "value": "M1[0-5]"},
        "by_start": {"field": "model", "operator": 2, "value": " M1 "},
        "by_end": {"field": "device", "operator": 3, "value": "7"},
        "by_part": {"fieldId": 21, "operator": 4, "value": "ROI"},
        "by_more": {"fieldId": 24, "operator": 6, "value": "1.2"},
        "by_less": {"fieldId": 24, "operator": 7, "value": "1.2"},
        "by_order": {"fieldId": 24, "operator": 8, "value": "1.2"},
        "by_most": {"fieldId": 24, "operator": 9, "value": "1.2"},
        "by_flag": {"fieldId": 11, "operator": 5, "value": "new"},
        "by_login": {"fieldId": 12, "operator": 5, "value": "yes"},
        "by_key": {"field": "k", "operator": 5, "value": "5"},
        "by_list": {"field": "k", "operator": 5, "value": ["5", 7, None, "", "50"]},
        "by_page": {"fieldId": 31, "operator": 5, "value": ["p3", "p4"]},
        "by_path": {"fieldId": "32", "operator": 5, "value": "/p3?k=3"},
        "by_host": {"id": 33, "operator": 5, "value": "app"},
    }
    # Free keys and page fields are read from JSON; page views stand for the driver's views.
    params = F.to_json(F.struct(
        F.get_json_object("event_params", "$.k").alias("k"), F.col("device_model").alias("model"), F.col("device_id").alias("device"), F.lit("app").alias("host"),
        F.concat(F.lit("p"), F.get_json_object("event_params", "$.k").cast("int") % 12).alias("page_name"),
        F.concat(F.lit("/p"), F.get_json_object("event_params", "$.k").cast("int") % 12).alias("path"),
        F.concat(F.lit("?k="), F.get_json_object("event_params", "$.k")).alias("query"),
    ))
    frame = t.marketing.withColumns({"event_params": params, "event_name": F.when(F.col("event_name") == "view", "page_view").otherwise(F.col("event_name"))})
    frame = decode.with_variants(frame) if parsed else frame
    tests = {name: conditions.build_predicate([{"conditions": [row]}], AS_OF, parsed).where for name, row in rows.items()}
    return frame.withColumns(tests).groupBy(*rows).agg(F.count(F.lit(1)).alias("cnt"))


@query("condition_operators_variant", CONDITION_FLAGS)
def _(t: Tables):
    return condition_flags(t, parsed=True)


@query(
    "condition_counts",
    """
    SELECT user_key, count(*) FILTER (k % 2 = 0) IN (1, 2, 3) OR count(*) FILTER (event_name = 'click') > 2 AS counted FROM mkt_event GROUP BY 1
    """,
)
def _(t: Tables):
    # The first row counts rows that have a value under a known field, the second an event by name.
    rows = [{"fieldId": 53, "type": "count", "operator": 5, "value": ["1", 2, "3", "x"]}, event("click", type="count", operator=6, value="2")]
    even = F.when(F.get_json_object("event_params", "$.k").cast("int") % 2 == 0, "even")
    having = conditions.build_predicate([{"conditions": rows}], AS_OF).having_column()
    return t.marketing.withColumn("campaign", even).groupBy("user_key").agg(having.alias("counted"))


@query(
    "user_status",
    """
    SELECT CASE WHEN event_time >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY THEN 'active' WHEN event_time >= TIMESTAMP '2024-02-20' - INTERVAL 60 DAY THEN 'sleep' ELSE 'dropoff' END AS status,
           count(*) AS cnt FROM mkt_event GROUP BY 1
    """,
)
def _(t: Tables):
    status = conditions.user_status(F.col("event_time"), dt.datetime(2024, 2, 20, tzinfo=dt.timezone.utc))
    return t.marketing.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "discover_group",
    f"""
    SELECT f AS find_count, n AS total_count, round(f / n, 6) AS rate FROM (SELECT
      (SELECT count(*) FROM (SELECT user_key FROM mkt_event WHERE {_PERIOD} AND (platform = 'Android' OR app_version LIKE '1.3%') AND event_name IN ('purchase', 'click')
                             GROUP BY 1 HAVING count(*) FILTER (event_name = 'purchase') >= 6)) AS f,
      (SELECT count(DISTINCT user_key) FROM mkt_event WHERE {_PERIOD}) AS n)
    """,
)
def _(t: Tables):
    return funnel.discover_group(funnel.in_period(t.marketing, START, END), CONDITION, AS_OF)


# Funnel by self joins, the plain way: chains of view, click and purchase within a day of the view.
_CHAINS = f"""
s1 AS (SELECT user_key, log_tm AS t FROM mkt_event WHERE event_name = 'view'),
s2 AS (SELECT user_key, log_tm AS t FROM mkt_event WHERE event_name = 'click'),
s3 AS (SELECT user_key, log_tm AS t FROM mkt_event WHERE event_name = 'purchase'),
c2 AS (SELECT s1.user_key, s1.t AS t1, s2.t AS t2 FROM s1 JOIN s2 ON s1.user_key = s2.user_key AND s2.t BETWEEN s1.t AND s1.t + {WINDOW_S * 1000}),
c3 AS (SELECT c2.user_key, s3.t AS t3 FROM c2 JOIN s3 ON c2.user_key = s3.user_key AND s3.t >= c2.t2 AND s3.t <= c2.t1 + {WINDOW_S * 1000}),
firsts AS (SELECT user_key, f1, f2, f3 FROM (SELECT DISTINCT user_key FROM mkt_event) LEFT JOIN (SELECT user_key, min(t) AS f1 FROM s1 GROUP BY 1) USING (user_key)
  LEFT JOIN (SELECT user_key, min(t2) AS f2 FROM c2 GROUP BY 1) USING (user_key) LEFT JOIN (SELECT user_key, min(t3) AS f3 FROM c3 GROUP BY 1) USING (user_key)),
stops AS (SELECT user_key, min(t) AS stop FROM (SELECT s2.user_key, s2.t FROM s2 JOIN firsts USING (user_key) WHERE s2.t > f2
  UNION ALL SELECT s3.user_key, s3.t FROM s3 JOIN firsts USING (user_key) WHERE s3.t > f3) GROUP BY 1),
loose AS (SELECT user_key, CASE WHEN f3 IS NOT NULL THEN 3 WHEN f2 IS NOT NULL THEN 2 WHEN f1 IS NOT NULL THEN 1 ELSE 0 END AS level FROM firsts),
strict AS (SELECT user_key, CASE WHEN f3 <= coalesce(stop, f3) THEN 3 WHEN f2 <= coalesce(stop, f2) THEN 2 WHEN f1 <= coalesce(stop, f1) THEN 1 ELSE 0 END AS level
  FROM firsts LEFT JOIN stops USING (user_key))
"""


@query("funnel_level", "SELECT user_key, level FROM strict", ctes=_CHAINS)
def _(t: Tables):
    return funnel.funnel_level(t.marketing, funnel.step_predicates(STEPS, AS_OF), WINDOW_S)


@query("funnel_level_loose", "SELECT user_key, level FROM loose", ctes=_CHAINS)
def _(t: Tables):
    return funnel.funnel_level(t.marketing, funnel.step_predicates(STEPS, AS_OF), WINDOW_S, strict=False)


@query(
    "discover_step",
    "SELECT count(*) FILTER (level >= 3) AS find_count, count(*) AS total_count, round(count(*) FILTER (level >= 3) / count(*), 6) AS rate FROM strict",
    ctes=_CHAINS,
)
def _(t: Tables):
    return funnel.discover_step(t.marketing, STEPS, AS_OF, WINDOW_S)


_SEGMENTS = """
asked AS (SELECT * FROM (VALUES (0, 'ALL'), (2, 'Android'), (3, 'Buyers'), (4, 'Nobody'), (5, 'Android')) v(segment_no, segment_key)),
segments AS (
  SELECT DISTINCT user_key, 0 AS segment_no FROM mkt_event
  UNION ALL SELECT DISTINCT user_key, 2 FROM mkt_event WHERE platform = 'Android'
  UNION ALL SELECT user_key, 3 FROM mkt_event GROUP BY 1 HAVING count(*) FILTER (event_name = 'purchase') > 14
  UNION ALL SELECT DISTINCT user_key, 5 FROM mkt_event WHERE platform IN ('iOS', 'Web'))
"""


@query("assign_segments", "SELECT user_key, segment_no, segment_key FROM segments JOIN asked USING (segment_no)", ctes=_SEGMENTS)
def _(t: Tables):
    return funnel.assign_segments(t.marketing, GROUPS, AS_OF)


_CLOSED = _CHAINS + "," + _SEGMENTS + """,
closed AS (
  SELECT a.segment_no, a.segment_key, step, count(*) FILTER (level >= step) AS active, CASE WHEN step < 3 THEN count(*) FILTER (level = step) END AS dropped,
         CASE WHEN step > 1 THEN count(*) FILTER (level >= step) END AS entrance, CAST(NULL AS BIGINT) AS skipped
  FROM asked a CROSS JOIN (VALUES (1), (2), (3)) v(step) LEFT JOIN (SELECT segment_no, level FROM strict JOIN segments USING (user_key)) s ON s.segment_no = a.segment_no GROUP BY 1, 2, 3)
"""


@query("funnel_closed", "SELECT segment_no, segment_key, step, active, dropped, entrance, skipped FROM closed", ctes=_CLOSED)
def _(t: Tables):
    return funnel.funnel_closed(t.marketing, STEPS, GROUPS, AS_OF, WINDOW_S)


_OPEN = _SEGMENTS + """,
times AS (SELECT user_key, min(log_tm) FILTER (event_name = 'view') AS a1, max(log_tm) FILTER (event_name = 'view') AS z1,
  min(log_tm) FILTER (event_name = 'click') AS a2, max(log_tm) FILTER (event_name = 'click') AS z2,
  min(log_tm) FILTER (event_name = 'purchase') AS a3, max(log_tm) FILTER (event_name = 'purchase') AS z3 FROM mkt_event GROUP BY 1),
placed AS (SELECT a.segment_no, a.segment_key, a1, z1, a2, z2, a3, z3 FROM asked a LEFT JOIN (SELECT * FROM times JOIN segments USING (user_key)) s ON s.segment_no = a.segment_no),
open_funnel AS (
  SELECT segment_no, segment_key, 1 AS step, count(a1) AS active, count(*) FILTER (a1 IS NOT NULL AND NOT coalesce(z2 >= a1, false)) AS dropped, CAST(NULL AS BIGINT) AS entrance, CAST(NULL AS BIGINT) AS skipped
  FROM placed GROUP BY 1, 2
  UNION ALL SELECT segment_no, segment_key, 2, count(a2), count(*) FILTER (a2 IS NOT NULL AND NOT coalesce(z3 >= a2, false)), count(*) FILTER (a2 IS NOT NULL AND NOT coalesce(z2 >= a1, false)), NULL
  FROM placed GROUP BY 1, 2
  UNION ALL SELECT segment_no, segment_key, 3, count(a3), NULL, count(*) FILTER (a3 IS NOT NULL AND NOT coalesce(z3 >= a2, false)),
    count(*) FILTER (a3 IS NOT NULL AND NOT coalesce(z3 >= a2, false) AND coalesce(z3 >= a1, false)) FROM placed GROUP BY 1, 2)
"""


@query("funnel_open", "SELECT segment_no, segment_key, step, active, dropped, entrance, skipped FROM open_funnel", ctes=_OPEN)
def _(t: Tables):
    return funnel.funnel_open(t.marketing, STEPS, GROUPS, AS_OF)


@query(
    "funnel_table",
    """
    SELECT segment_no, segment_key, CAST(step AS BIGINT) AS step, active AS active_count, dropped AS dropoff_count,
           CASE WHEN step < 3 THEN CASE WHEN active > 0 THEN round(nxt * 100.0 / active, 2) ELSE 0 END END AS conversion_rate,
           CASE WHEN step < 3 THEN CASE WHEN active > 0 THEN round(100 - round(nxt * 100.0 / active, 2), 2) ELSE 0 END END AS dropoff_rate,
           entrance AS entrance_count, skipped AS skipped_count
    FROM (SELECT *, lead(active) OVER (PARTITION BY segment_no ORDER BY step) AS nxt FROM closed)
    """,
    ctes=_CLOSED,
)
def _(t: Tables):
    return funnel.funnel_table(funnel.funnel_closed(t.marketing, STEPS, GROUPS, AS_OF, WINDOW_S))
