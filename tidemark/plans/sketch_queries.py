"""Sketches stored by hour or day, against exact answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sketches
from tidemark.plans.registry import Tables, query, scratch

DAY = dt.date(2024, 1, 20)
WEEK = (dt.date(2024, 1, 8), dt.date(2024, 1, 14))
POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
OFF = 0.02  # rank error that counts as near; the sketch promises less


def stored(t: Tables, name: str, rows: DataFrame) -> DataFrame:
    """Rows written to a table and read back, as sketches are between days."""
    place = scratch(t.spark, name)
    rows.write.parquet(place)
    return t.spark.read.parquet(place)


@query(
    "range_quantiles_near",
    f"""
    SELECT package_nm, server_type, point, count(*) AS n, true AS is_near FROM page_flow CROSS JOIN (VALUES ('p50'), ('p90'), ('p99')) v(point)
    WHERE intervaltime IS NOT NULL AND page_start_tm_dt >= TIMESTAMP '{WEEK[0]}' AND page_start_tm_dt < TIMESTAMP '{WEEK[1]}' + INTERVAL 1 DAY GROUP BY ALL
    """,
)
def _(t: Tables):
    """Quantiles of a week from hourly sketches, each judged by the share of exact rows at or below it."""
    by, week = ["package_nm", "server_type"], F.to_date("hour_bucket").between(F.lit(WEEK[0]), F.lit(WEEK[1]))
    hours = stored(t, "hourly", sketches.hourly_quantiles(t.pages, by, "intervaltime"))
    near = sketches.range_quantiles(hours.filter(week), by, POINTS)
    listed = near.select(*by, "n", F.explode(F.map_from_arrays(F.array(*map(F.lit, POINTS)), F.array(*POINTS))).alias("point", "found"))
    aimed = F.element_at(F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair]), F.col("point"))
    rows = t.pages.filter(F.to_date("page_start_tm_dt").between(F.lit(WEEK[0]), F.lit(WEEK[1])) & F.col("intervaltime").isNotNull())
    # A row counts below or at the value for each point; the rank aimed at lies between the two shares, give or take the error.
    shares = rows.join(listed, by).groupBy(*by, "n", "point").agg(
        F.avg((F.col("intervaltime") < F.col("found")).cast("double")).alias("below"), F.avg((F.col("intervaltime") <= F.col("found")).cast("double")).alias("upto"),
    )
    return shares.select(*by, "point", "n", ((F.col("below") - OFF <= aimed) & (aimed <= F.col("upto") + OFF)).alias("is_near"))


@query(
    "active_users_sketch",
    f"""
    SELECT package_nm, server_type, os_type, count(*) FILTER (d) AS dau, count(*) FILTER (d AND w) AS revisit_7d, count(*) AS mau FROM (
      SELECT package_nm, server_type, os_type, device_id, bool_or(log_date = DATE '{DAY}') AS d, bool_or(log_date >= DATE '{DAY}' - INTERVAL 7 DAY AND log_date < DATE '{DAY}') AS w
      FROM access_history WHERE log_date BETWEEN DATE '{DAY}' - INTERVAL 30 DAY AND DATE '{DAY}' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) FILTER (d) > 0
    """,
)
def _(t: Tables):
    """Exact here, since no app has more devices than a sketch holds."""
    return sketches.active_users_sketch(stored(t, "sets", sketches.daily_devices(t.access)), DAY)


@query(
    "range_users_sketch",
    f"""
    SELECT package_nm, server_type, os_type, count(*) FILTER (n) AS users, count(*) FILTER (n AND b) AS returned FROM (
      SELECT package_nm, server_type, os_type, device_id, bool_or(log_date >= DATE '{WEEK[0]}') AS n, bool_or(log_date < DATE '{WEEK[0]}') AS b
      FROM access_history WHERE log_date BETWEEN DATE '{WEEK[0]}' - INTERVAL 7 DAY AND DATE '{WEEK[1]}' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) FILTER (n) > 0
    """,
)
def _(t: Tables):
    return sketches.range_users_sketch(stored(t, "sets", sketches.daily_devices(t.access)), *WEEK)


@query(
    "top_messages_sketch",
    """
    SELECT log_name, cnt, round(cnt * 100.0 / total, 4) AS share, rank FROM (
      SELECT log_name, count(*) AS cnt, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, log_name) AS rank FROM trouble_log GROUP BY 1) WHERE rank <= 10
    """,
)
def _(t: Tables):
    """Exact here, since a state holds all messages."""
    hours = stored(t, "hitters", sketches.hourly_hitters(t.trouble, "log_name", tracked=1000))
    return sketches.range_hitters(hours, "log_name", tracked=1000)
