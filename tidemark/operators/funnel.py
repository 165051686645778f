"""Audiences and funnels: who did what, in which order, how fast."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import literal_frame
from tidemark.operators.conditions import Predicate, build_predicate

USER = "user_key"


def in_period(events: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Events from ``start`` to ``end`` plus one day, the end left out."""
    return events.filter((F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end + dt.timedelta(days=1))))


def default_period(as_of: dt.datetime, days: int = 7) -> tuple[dt.datetime, dt.datetime]:
    return as_of - dt.timedelta(days=days), as_of


def _rate(found: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.round(F.col(found) / F.when(F.col(total) > 0, F.col(total)), 6)).otherwise(0.0)


def discover_group(events: DataFrame, condition: Sequence[Mapping[str, Any]], as_of: dt.datetime) -> DataFrame:
    """Users with a matching row, whose matching rows meet the counts, against all users.

    One pass: every user becomes one row of flags, then the flags are counted.
    """
    pred = build_predicate(condition, as_of)
    where = pred.where if pred.where is not None else F.lit(True)
    having = pred.having_column(where)
    hit = F.bool_or(where)
    users = events.groupBy(USER).agg((hit & having if having is not None else hit).alias("_hit"))
    counts = users.agg(F.count_if("_hit").alias("find_count"), F.count(F.lit(1)).alias("total_count"))
    return counts.withColumn("rate", _rate("find_count", "total_count"))


def step_predicates(steps: Sequence[Mapping[str, Any]], as_of: dt.datetime) -> list[Column]:
    """Row condition of each step; a step without conditions takes every row."""
    preds = [build_predicate(step.get("condition") or (), as_of) for step in steps]
    return [p.where if p.where is not None else F.lit(True) for p in preds]


def step_hits(events: DataFrame, steps: Sequence[Column], by: Sequence[str] = (USER,)) -> DataFrame:
    """One row per group, time and step met, with how often. A row that meets two steps counts for both."""
    met = F.filter(F.array(*[F.when(cond, F.lit(i)) for i, cond in enumerate(steps, 1)]), lambda x: x.isNotNull())
    hits = events.select(*by, F.unix_millis("event_time").alias("ts"), F.explode(met).alias("step"))
    return hits.groupBy(*by, "ts", "step").agg(F.count(F.lit(1)).alias("n"))


def first_reached(hits: DataFrame, n_steps: int, window_ms: int, by: Sequence[str] = (USER,)) -> DataFrame:
    """Per group the first time each step is reached in order, all within the window of the first step.

    Order is time, then step. For a chain only its latest possible start matters, so reaching step k is
    a running maximum of starts. A chain cannot be longer than the window, so time is cut into slices of
    that length, and each slice sees its own rows and the next slice's, with starts in its own only. No
    group is ordered whole, however many rows it has.
    """
    own = F.floor(F.col("ts") / window_ms)
    placed = hits.withColumn("_at", F.explode(F.array(own, own - 1))).withColumn("_own", own == F.col("_at"))
    order = Window.partitionBy(*by, "_at").orderBy("ts", "step").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_s1", F.max(F.when((F.col("step") == 1) & F.col("_own"), F.col("ts"))).over(order))
    reached = [F.min(F.when(F.col("step") == 1, F.col("ts"))).alias("f1")]
    for k in range(2, n_steps + 1):
        start = F.col(f"_s{k - 1}")
        hit = (F.col("step") == k) & (F.col("ts") <= start + window_ms)
        rows = rows.withColumn(f"_h{k}", F.coalesce(hit, F.lit(False)))
        rows = rows.withColumn(f"_s{k}", F.max(F.when(F.col(f"_h{k}"), start)).over(order))
        reached.append(F.min(F.when(F.col(f"_h{k}"), F.col("ts"))).alias(f"f{k}"))
    return rows.groupBy(*by).agg(*reached)


def _stops(hits: DataFrame, reached: DataFrame, n_steps: int, window_ms: int, by: Sequence[str]) -> DataFrame:
    """Per group the first repeat of a step already reached (steps after the first).

    First times are copied to each slice in which the group has rows, and joined by (group, slice), so
    a group with very many rows is spread out.
    """
    sliced = hits.filter("step > 1").withColumn("_slice", F.floor(F.col("ts") / window_ms))
    slices = sliced.groupBy(*by, "_slice").agg(F.lit(1).alias("_x")).drop("_x").join(reached, list(by))
    rows = sliced.join(slices, [*by, "_slice"])
    first = F.element_at(F.array(*[F.col(f"f{k}") for k in range(1, n_steps + 1)]), F.col("step"))
    repeat = (F.col("ts") > first) | ((F.col("ts") == first) & (F.col("n") > 1))
    return rows.filter(repeat).groupBy(*by).agg(F.min(F.struct("ts", "step")).alias("stop"))


def funnel_level(
    events: DataFrame, steps: Sequence[Column], window_s: int = 3600, strict: bool = True, by: Sequence[str] = (USER,)
) -> DataFrame:
    """Highest step each group reaches in order within the window of its first step, 0 when none.

    In strict mode a repeat of a step already met, other than the first, ends the matching.
    """
    by, n = list(by), len(steps)
    hits = step_hits(events, steps, by)
    reached = first_reached(hits, n, window_s * 1000, by)
    if strict and n > 1:
        reached = reached.join(_stops(hits, reached, n, window_s * 1000, by), by, "left")
        ahead = [
            F.col(f"f{k}").isNotNull()
            & (F.col("stop").isNull() | (F.struct(F.col(f"f{k}").alias("ts"), F.lit(k).alias("step")) <= F.col("stop")))
            for k in range(1, n + 1)
        ]
    else:
        ahead = [F.col(f"f{k}").isNotNull() for k in range(1, n + 1)]
    level = F.lit(0)
    for k, cond in enumerate(ahead, 1):
        level = F.when(cond, F.lit(k)).otherwise(level)
    everyone = events.groupBy(*by).agg(F.lit(0).alias("level"))
    found = reached.select(*by, level.alias("level"))
    return everyone.unionByName(found).groupBy(*by).agg(F.max("level").cast("long").alias("level"))


def discover_step(
    events: DataFrame, steps: Sequence[Mapping[str, Any]], as_of: dt.datetime, window_s: int = 3600, strict: bool = True
) -> DataFrame:
    """Users who reach the last step, against all users."""
    levels = funnel_level(events, step_predicates(steps, as_of), window_s, strict)
    counts = levels.agg(F.count_if(F.col("level") >= len(steps)).alias("find_count"), F.count(F.lit(1)).alias("total_count"))
    return counts.withColumn("rate", _rate("find_count", "total_count"))


ALL = "ALL"


def asked_segments(groups: Sequence[Mapping[str, Any]]) -> list[tuple[int, str, Mapping[str, Any] | None]]:
    """Number, name and definition of each segment: 0 for everyone, then the groups by position. Names may repeat, numbers do not."""
    named = [(i, (group.get("name") or f"Group {i}").strip(), group) for i, group in enumerate(groups, 1)]
    return [(0, ALL, None), *[x for x in named if x[1].upper() != ALL]]


def _member(group: Mapping[str, Any] | None, as_of: dt.datetime) -> Column:
    """Aggregate condition of a user's rows: some row meets the row conditions, all rows together the counts."""
    pred = Predicate() if group is None else build_predicate(group.get("condition") or (), as_of)
    parts = [pred.having_column(), None if pred.where is None else F.bool_or(pred.where)]
    flag = F.lit(True)
    for part in parts:
        flag = flag if part is None else flag & part
    return flag


def assign_segments(events: DataFrame, groups: Sequence[Mapping[str, Any]], as_of: dt.datetime) -> DataFrame:
    """(user, segment) rows: ALL, and each group whose row and count conditions the user meets."""
    asked = asked_segments(groups)
    users = events.groupBy(USER).agg(*[_member(group, as_of).alias(f"_g{i}") for i, _, group in asked])
    members = F.array(*[F.when(F.col(f"_g{i}"), F.struct(F.lit(i).alias("segment_no"), F.lit(name).alias("segment_key"))) for i, name, _ in asked])
    return users.select(USER, F.inline(F.filter(members, lambda x: x.isNotNull())))


SEGMENT = ["segment_no", "segment_key"]


def _by_segment(per_user: DataFrame, events: DataFrame, groups: Sequence[Mapping[str, Any]], as_of: dt.datetime, aggs: Mapping[str, Column]) -> DataFrame:
    """Counts of each asked segment, 0 for one without users."""
    found = per_user.join(assign_segments(events, groups, as_of), USER).groupBy("segment_no").agg(*[c.alias(n) for n, c in aggs.items()])
    asked = literal_frame(events.sparkSession, [(i, name) for i, name, _ in asked_segments(groups)], SEGMENT)
    return asked.join(found, "segment_no", "left").fillna(0, list(aggs))


def _unpivot_steps(wide: DataFrame, n: int, names: Sequence[str]) -> DataFrame:
    steps = [
        F.struct(F.lit(k).alias("step"), *[
            (F.col(f"{name}_{k}") if f"{name}_{k}" in wide.columns else F.lit(None).cast("long")).alias(name) for name in names
        ])
        for k in range(1, n + 1)
    ]
    return wide.select(*SEGMENT, F.inline(F.array(*steps)))


def funnel_closed(
    events: DataFrame, steps: Sequence[Mapping[str, Any]], groups: Sequence[Mapping[str, Any]], as_of: dt.datetime,
    window_s: int = 3600, strict: bool = True,
) -> DataFrame:
    """Per segment and step: users who reach it in order, those who stop there, those who come in.

    The stored query is not known; the columns follow what the step table reads.
    """
    n = len(steps)
    levels = funnel_level(events, step_predicates(steps, as_of), window_s, strict)
    aggs = {f"active_{k}": F.count_if(F.col("level") >= k) for k in range(1, n + 1)}
    aggs |= {f"dropped_{k}": F.count_if(F.col("level") == k) for k in range(1, n)}
    aggs |= {f"entrance_{k}": F.count_if(F.col("level") >= k) for k in range(2, n + 1)}
    wide = _by_segment(levels, events, groups, as_of, aggs)
    return _unpivot_steps(wide, n, ["active", "dropped", "entrance", "skipped"])


def funnel_open(
    events: DataFrame, steps: Sequence[Mapping[str, Any]], groups: Sequence[Mapping[str, Any]], as_of: dt.datetime
) -> DataFrame:
    """Per segment and step when users may come in anywhere.

    active: users who did the step. entrance: those of them who did not do the step before first.
    skipped: entrants who did some step further back first. dropped: those who never go on to the next
    step. A step follows another when its last time is not before the other's first, so a user's first
    and last time of each step decide everything.
    """
    n = len(steps)
    conds = step_predicates(steps, as_of)
    ms = F.unix_millis("event_time")
    times = [agg(F.when(c, ms)).alias(f"{p}{k}") for k, c in enumerate(conds, 1) for agg, p in ((F.min, "a"), (F.max, "z"))]
    per_user = events.groupBy(USER).agg(*times)

    def did(k: int) -> Column:
        return F.col(f"a{k}").isNotNull()

    def follows(later: int, earlier: int) -> Column:
        return F.coalesce(F.col(f"z{later}") >= F.col(f"a{earlier}"), F.lit(False))

    aggs = {}
    for k in range(1, n + 1):
        aggs[f"active_{k}"] = F.count_if(did(k))
        if k < n:
            aggs[f"dropped_{k}"] = F.count_if(did(k) & ~follows(k + 1, k))
        if k > 1:
            enters = did(k) & ~follows(k, k - 1)
            aggs[f"entrance_{k}"] = F.count_if(enters)
            if k > 2:
                back = F.lit(False)
                for j in range(1, k - 1):
                    back = back | follows(k, j)
                aggs[f"skipped_{k}"] = F.count_if(enters & back)
    wide = _by_segment(per_user, events, groups, as_of, aggs)
    return _unpivot_steps(wide, n, ["active", "dropped", "entrance", "skipped"])


def funnel_table(levels: DataFrame) -> DataFrame:
    """Step table: drop-off as given or active less the next step's, rates with two decimals to the next step.

    A segment has one row per step, which bounds the window.
    """
    order = Window.partitionBy(*SEGMENT).orderBy("step")
    following = F.lead("active").over(order)
    last = following.isNull()
    conversion = F.when(F.col("active") > 0, F.round(following / F.when(F.col("active") > 0, F.col("active")) * 100, 2)).otherwise(0.0)
    rest = F.when(F.col("active") > 0, F.round(100 - conversion, 2)).otherwise(0.0)
    return levels.select(
        *SEGMENT, F.col("step").cast("long").alias("step"), F.col("active").alias("active_count"),
        F.when(last, F.lit(None)).otherwise(F.coalesce("dropped", F.greatest(F.col("active") - following, F.lit(0)))).cast("long").alias("dropoff_count"),
        F.when(~last, conversion).alias("conversion_rate"), F.when(~last, rest).alias("dropoff_rate"),
        F.when(F.col("step") > 1, F.coalesce("entrance", F.lit(0))).alias("entrance_count"),
        F.when(F.col("step") > 2, F.col("skipped")).alias("skipped_count"),
    )
