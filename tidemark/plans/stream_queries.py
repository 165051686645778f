"""Streams played over the driver tables in several runs, against the batch answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, query, scratch
from tidemark.plans.rollup_queries import _MEASURES
from tidemark.streaming import differences, streams

HOUR = 3_600_000
GAP = 12 * HOUR


def play(t: Tables, arrivals: Sequence[DataFrame], name: str, start: Callable) -> str:
    """Add one frame after the other to a folder, and let the streams that ``start(rows, place, checkpoint)`` gives read what is new."""
    place, by_entry = scratch(t.spark, name), streams.stateful_session(t.spark)
    for frame in arrivals:
        frame.write.mode("append").parquet(f"{place}/in")
        rows = by_entry.readStream.schema(frame.schema).parquet(f"{place}/in")
        for run in start(rows, f"{place}/out", f"{place}/checkpoint"):
            run.awaitTermination()
            if run.exception() is not None:
                raise run.exception()
    return f"{place}/out"


@query(
    "rollup_by_differences",
    f"""
    SELECT CAST(log_date AS VARCHAR) AS log_date, package_nm, server_type, os_type, page_name, {_MEASURES},
           sum(intervaltime) / count(intervaltime) AS avg_intervaltime, sum(loading_time) / count(loading_time) AS avg_loading_time FROM page_flow GROUP BY ALL
    """,
)
def _(t: Tables):
    """A third of the pages comes wrong first and is corrected, some come twice, some late; the first two runs are settled into a base."""
    pages = t.pages.withColumn("version", F.lit(2).cast("long"))
    wrong = pages.withColumns({
        "version": F.lit(1).cast("long"), "page_name": F.concat("page_name", F.lit("/draft")), "intervaltime": F.lit(7).cast("long"), "log_date": F.date_sub("log_date", 1),
    })
    third = F.pmod(F.xxhash64("page_id"), F.lit(3))
    arrivals = [
        wrong.filter(third == 0).unionByName(pages.filter(third == 1)),
        pages.filter((third == 0) | ((third == 1) & (F.col("page_id") % 4 == 0))),
        pages.filter(third == 2).unionByName(wrong.filter((third == 0) & (F.col("page_id") % 4 == 0))),
    ]

    def start(rows: DataFrame, place: str, checkpoint: str) -> list:
        differences.settle_differences(t.spark, place)
        changes = differences.signed_changes(rows, ["device_id", "page_id"], version="version")
        return [streams.run_stream(changes, differences.difference_sink(place), "differences", checkpoint, available_now=True)]

    return differences.read_differences(t.spark, play(t, arrivals, "differences", start), [*differences.BY])


@query("dedup_in_stream", "SELECT event_id, log_tm, CASE WHEN event_id % 50 = 0 THEN 'late' ELSE 'in time' END AS place FROM event_log")
def _(t: Tables):
    """Events that arrive within an hour, every seventh twice; every fiftieth arrives days late and goes to a table of its own."""
    late = F.col("event_id") % 50 == 0
    came = F.col("log_tm") + F.when(late, F.lit(72 * HOUR)).otherwise(F.col("event_id") % 3_000_000)
    rows = t.events.select("event_id", "log_tm", "log_tm_dt").withColumn("reg_dt", F.timestamp_millis(came))
    again = rows.filter((F.col("event_id") % 7 == 0) & ~late).withColumn("reg_dt", F.least(F.col("reg_dt") + F.expr("INTERVAL 5 MINUTES"), F.col("log_tm_dt") + F.expr("INTERVAL 1 HOUR")))
    every = rows.unionByName(again)
    # Each run brings ten days; copies around midnight come in another run than their first.
    run_of = F.floor((F.unix_seconds("reg_dt") - F.lit(1704067200)) / (10 * 86_400))
    arrivals = [every.filter(run_of < 1), every.filter(run_of == 1), every.filter(run_of > 1)]

    def start(stream: DataFrame, place: str, checkpoint: str) -> list:
        sinks = [streams.table_sink(f"{place}/{name}", []) for name in ("rows", "late")]
        return streams.run_deduplicated(stream, ["event_id"], "log_tm_dt", "reg_dt", "1 hour", "11 days", *sinks, "dedup", checkpoint, available_now=True)

    place = play(t, arrivals, "dedup", start)
    read = lambda name, label: t.spark.read.parquet(f"{place}/{name}").select("event_id", "log_tm", F.lit(label).alias("place"))
    return read("rows", "in time").unionByName(read("late", "late"))


@query(
    "session_windows",
    f"""
    SELECT package_nm, device_id, min(page_start_tm) AS parent_log_date, max(page_start_tm) AS last_page_tm, count(*) AS page_count, max(page_end_tm) AS session_end_tm,
           count(*) FILTER (log_type = 2097152) AS crash_count FROM (
      SELECT *, sum(opens) OVER (PARTITION BY package_nm, device_id ORDER BY page_start_tm, page_id) AS no FROM (
        SELECT *, CASE WHEN page_start_tm - lag(page_start_tm) OVER (PARTITION BY package_nm, device_id ORDER BY page_start_tm, page_id) <= {GAP} THEN 0 ELSE 1 END AS opens FROM page_flow))
    GROUP BY package_nm, device_id, no
    """,
)
def _(t: Tables):
    """Sessions of pages that come in two runs, every other page late; a page far ahead lets the watermark pass them all."""
    pages = t.pages.select("package_nm", "device_id", "page_id", "page_start_tm", "page_end_tm", "log_type")
    ahead = pages.agg(*[(F.max(c) + 1000 * 24 * HOUR if c == "page_start_tm" else F.max(c)).alias(c) for c in pages.columns]).withColumn("device_id", F.lit("_ahead"))
    odd = F.col("page_id") % 2 == 1
    arrivals = [pages.filter(~odd), pages.filter(odd), ahead.select(*pages.columns)]

    def start(rows: DataFrame, place: str, checkpoint: str) -> list:
        return [streams.run_stream(streams.session_stream(rows, GAP, "40 days"), streams.table_sink(place, []), "sessions", checkpoint, available_now=True)]

    found = t.spark.read.parquet(play(t, arrivals, "sessions", start)).drop("batch_id")
    return found.filter("device_id <> '_ahead'")


@query(
    "scatter_sample_stream",
    """
    SELECT package_nm, count(*) AS cnt, count(*) FILTER (intervaltime >= 1500) AS slow FROM (
      SELECT * FROM event_log WHERE intervaltime >= 1500 UNION ALL
      (SELECT * FROM event_log WHERE intervaltime < 1500 QUALIFY row_number() OVER (PARTITION BY package_nm, server_type ORDER BY event_id) <= 100)) GROUP BY 1
    """,
)
def _(t: Tables):
    rows = t.events.select("event_id", "package_nm", "server_type", "intervaltime")
    arrivals = [rows.filter(F.col("event_id") % 3 == i) for i in range(3)]

    def start(stream: DataFrame, place: str, checkpoint: str) -> list:
        return [streams.run_stream(stream, streams.sample_sink(place, "intervaltime", ["event_id"], cap=100), "sample", checkpoint, available_now=True)]

    place = play(t, arrivals, "sample", start)
    sample = streams.read_sample(t.spark, place, rows.schema, "intervaltime", ["event_id"], cap=100)
    return sample.groupBy("package_nm").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("intervaltime") >= 1500).alias("slow"))


@query(
    "replay_loads",
    """
    SELECT e.device_id, e.log_tm, e.log_type, CASE WHEN e.log_type = 131073 THEN p.loading_time END AS loading_time
    FROM event_log e LEFT JOIN page_flow p ON p.device_id = e.device_id AND p.page_start_tm = e.log_tm AND p.page_id % 5 <> 0
    WHERE e.log_type IN (131073, 131088, 131077)
    """,
)
def _(t: Tables):
    """Actions and pages as two streams, pages of half the devices a run later, a fifth of the pages never; rows far ahead end the waiting."""
    actions = t.events.select("device_id", "log_tm", "log_type", "event_id").withColumn("kind", F.lit("action"))
    pages = t.pages.filter("page_id % 5 <> 0").select("device_id", "page_start_tm", "loading_time")
    ahead_tm = F.lit(1704067200000 + 1000 * 24 * HOUR)
    both = actions.select("device_id", "log_tm", "log_type", F.lit(None).cast("long").alias("page_start_tm"), F.lit(None).cast("long").alias("loading_time")).unionByName(
        pages.select("device_id", F.lit(None).cast("long").alias("log_tm"), F.lit(None).cast("long").alias("log_type"), "page_start_tm", "loading_time")
    )
    later = F.col("page_start_tm").isNotNull() & (F.pmod(F.xxhash64("device_id"), F.lit(2)) == 0)
    ahead = both.agg(F.lit("_ahead").alias("device_id"), ahead_tm.alias("log_tm"), F.lit(131073).cast("long").alias("log_type"), F.lit(None).cast("long").alias("page_start_tm"), F.lit(None).cast("long").alias("loading_time"))
    ahead_page = ahead.select("device_id", F.lit(None).cast("long").alias("log_tm"), F.lit(None).cast("long").alias("log_type"), ahead_tm.alias("page_start_tm"), F.lit(1).cast("long").alias("loading_time"))
    arrivals = [both.filter(~later), both.filter(later), ahead.unionByName(ahead_page)]

    def start(rows: DataFrame, place: str, checkpoint: str) -> list:
        shown = rows.filter("log_tm IS NOT NULL").select("device_id", "log_tm", "log_type")
        loads = rows.filter("page_start_tm IS NOT NULL").select("device_id", "page_start_tm", "loading_time")
        return [streams.run_stream(streams.replay_loads(shown, loads, "40 days", "1 minute"), streams.table_sink(place, []), "loads", checkpoint, available_now=True)]

    found = t.spark.read.parquet(play(t, arrivals, "loads", start))
    return found.filter("device_id <> '_ahead'").select("device_id", "log_tm", "log_type", "loading_time")
