"""Micro-batch runs, sinks and live snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import logtypes as lt
from tidemark.operators import ingest, widgets
from tidemark.operators.common import count_rows
from tidemark.sources import decode, files

BatchFn = Callable[[DataFrame, int], None]
BY_ENTRY = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state by entry; the caller's settings stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", BY_ENTRY)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    return session


def run_stream(
    df: DataFrame, fn: BatchFn, name: str, checkpoint: str, trigger_s: int | None = None, available_now: bool = False
) -> StreamingQuery:
    """Run ``fn`` on every micro-batch, on a fixed trigger when given.

    Offsets and state are kept in ``checkpoint``, a folder that outlives the session and that every machine reaches.
    """
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder of its own")
    writer = df.writeStream.queryName(name).foreachBatch(fn).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif trigger_s is not None:
        writer = writer.trigger(processingTime=f"{trigger_s} seconds")
    return writer.start()


def decode_packets(packets: DataFrame, key: str | None = None) -> DataFrame:
    """Packets (key, value, timestamp) to event_log rows with arrival time and clock-skew tag."""
    lines = decode.explode_packets(packets).withColumnRenamed("timestamp", "reg_dt")
    if key is not None:
        lines = decode.decrypt_lines(lines, "value", key)
    events = decode.decode_events(lines.drop("server_type", "package_id"))
    return ingest.tag_clock_skew(events, "reg_dt")


def table_sink(
    path: str, partitions: Sequence[str] = files.PARTITIONS, doc_id: Sequence[str] | None = None, version: str | None = None,
    dead_letter: str | None = None,
) -> BatchFn:
    """Write each micro-batch under its id; a failed write goes to the dead letters."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def sink(rows: DataFrame) -> None:
            files.write_batch(rows, path, batch_id, partitions, doc_id, version)

        if dead_letter is None:
            sink(batch)
        else:
            files.write_with_dead_letter(batch, sink, dead_letter, batch_id)

    return write


def routed_sink(path: str, version: str | None = "reg_dt") -> BatchFn:
    """Write a micro-batch of events as event rows, waterfall rows and trouble rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            keys = ["log_tm", "device_id", "mem_usage"]
            for name, rows in ingest.route_by_type(batch).items():
                files.write_batch(rows, f"{path}/{name}", batch_id, doc_id=keys, version=version)
            files.write_batch(ingest.derive_trouble(batch), f"{path}/trouble", batch_id, doc_id=keys, version=version)
        finally:
            batch.unpersist()

    return write


def increment_sink(path: str, keys: Sequence[str], version: str) -> BatchFn:
    """Keep the newest row of each key, however late it comes: the stream's form of ``widgets.merge_increment``.

    Each micro-batch writes its newest row of a key under its own id; ``read_increment`` settles the batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        files.write_batch(files.one_per_doc(batch, list(keys), version), path, batch_id, [])

    return write


def read_increment(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str) -> DataFrame:
    return files.read_latest(spark, path, schema, keys, version)


def split_late(rows: DataFrame, event_time: str, arrival: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """Rows that came within ``delay`` of their own time, and the rest: those that came later, before their time, or without one.

    A watermark drops late rows without a trace; told apart by their arrival, they can be kept.
    """
    own, came = F.col(event_time), F.col(arrival)
    in_time = F.coalesce(own.between(came - F.expr(f"INTERVAL {delay}"), came), F.lit(False))
    return rows.filter(in_time), rows.filter(~in_time)


def dedup_stream(rows: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first arrival of each key, whatever batches bring the copies: the stream's form of ``ingest.dedup_latest`` for rows that do not change.

    A key is remembered until the watermark is ``delay`` past its row, so state is bounded by that much of the stream.
    """
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_deduplicated(
    rows: DataFrame, keys: Sequence[str], event_time: str, arrival: str, delay: str, slack: str, sink: BatchFn, late_sink: BatchFn, name: str,
    checkpoint: str, trigger_s: int | None = None, available_now: bool = False,
) -> list[StreamingQuery]:
    """Two runs over one source: each key's row once to ``sink``, and late rows as they are to ``late_sink``.

    ``slack`` is how far rows of the source may be out of order by arrival; the watermark waits that much longer, so no row that is in time is dropped.
    """
    in_time, late = split_late(rows, event_time, arrival, delay)
    once = dedup_stream(in_time, keys, event_time, f"{delay} {slack}")
    return [
        run_stream(once, sink, name, f"{checkpoint}/rows", trigger_s, available_now),
        run_stream(late, late_sink, f"{name}_late", f"{checkpoint}/late", trigger_s, available_now),
    ]


def session_stream(pages: DataFrame, gap_ms: int, delay: str, ts: str = "page_start_tm", by: Sequence[str] = ("package_nm", "device_id")) -> DataFrame:
    """Sessions by idle gap with their first and last moments and page counts; a late page extends a session, or joins two.

    A session is given out once the watermark has passed its end by the gap. Pages whose distance is the gap itself are of one session, as in
    ``session.sessionize``.
    """
    timed = pages.withColumn("_at", F.timestamp_millis(ts)).withWatermark("_at", delay)
    sessions = timed.groupBy(*by, F.session_window("_at", f"{gap_ms + 1} milliseconds")).agg(
        F.min(ts).alias("parent_log_date"), F.max(ts).alias("last_page_tm"), count_rows("page_count"), F.max("page_end_tm").alias("session_end_tm"),
        F.count_if(F.col("log_type") == lt.CRASH).alias("crash_count"),
    )
    return sessions.drop("session_window")


def sample_sink(path: str, metric: str, ids: Sequence[str], slow_ms: int = 1500, cap: int = 2000, seed: int = 0, by: Sequence[str] = ("package_nm", "server_type")) -> BatchFn:
    """Keep what a batch adds to ``widgets.scatter_sample`` of all rows: its slow rows, and its ``cap`` first others of each app by hash.

    The first of all rows are among the first of their batches, so the samples of the batches merge to that of all rows, whatever the batches. A
    batch writes ``cap`` others of an app at most.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = files.one_per_doc(batch, list(ids))
        files.write_batch(widgets.scatter_sample(rows, metric, "", ids, "all", slow_ms, cap, seed=seed, by=by), path, batch_id, [])

    return write


def read_sample(
    spark: SparkSession, path: str, schema: T.StructType, metric: str, ids: Sequence[str], slow_ms: int = 1500, cap: int = 2000, seed: int = 0,
    by: Sequence[str] = ("package_nm", "server_type"),
) -> DataFrame:
    """The sample of all rows so far, from those of the batches; a row that several batches brought counts once."""
    rows = files.read_latest(spark, path, schema, ids)
    return widgets.scatter_sample(rows, metric, "", ids, "all", slow_ms, cap, seed=seed, by=by)


def join_intervals(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, delay: str, before: str, after: str, keep_unmatched: bool = True,
) -> DataFrame:
    """Rows of two streams with equal keys, the right one from ``before`` the left row's time to ``after`` it, whichever comes first.

    Both sides wait for their watermark and the range, so state is bounded on either side. A left row without a partner is given out, with NULLs, once none
    can come any more. The right side's keys are left out; its other columns need names of their own.
    """
    one, two = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    near = F.col(right_time).between(F.col(left_time) - F.expr(f"INTERVAL {before}"), F.col(left_time) + F.expr(f"INTERVAL {after}"))
    met = one.join(two, reduce(Column.__and__, [*same, near]), "left" if keep_unmatched else "inner")
    return met.drop(*[f"_r_{k}" for k in keys])


def replay_loads(actions: DataFrame, pages: DataFrame, delay: str, wait: str) -> DataFrame:
    """Replay actions with the loading time of the page that begins with them, the stream's form of ``session.replay_actions``.

    The page row of (device, time) may come before or after the action; actions without one by ``wait`` keep NULL. Both frames have ``log_tm``-like moments in
    epoch milliseconds, ``page_start_tm`` for pages.
    """
    shown = actions.filter(F.col("log_type").isin(*lt.REPLAY)).withColumn("_at", F.timestamp_millis("log_tm"))
    loads = pages.select("device_id", F.col("page_start_tm").alias("log_tm"), F.col("loading_time").alias("_load"), F.timestamp_millis("page_start_tm").alias("_load_at"))
    met = join_intervals(shown, loads, ["device_id", "log_tm"], "_at", "_load_at", delay, wait, wait)
    return met.withColumn("loading_time", F.when(F.col("log_type").isin(*lt.WEB_PAGE), F.col("_load"))).drop("_load", "_at", "_load_at")


def late_identities(events: DataFrame, identities: DataFrame, delay: str, wait: str) -> DataFrame:
    """Events with ``mapped_user``, the user that an identity row names for the device up to ``wait`` before or after; NULL if none comes.

    A device with several identity rows in that time gives a row for each, newest settled by ``ingest.dedup_latest`` downstream, by ``identity_at``.
    """
    named = identities.filter(F.trim("user_id") != "").select("device_id", F.col("user_id").alias("mapped_user"), F.col("updated_at").alias("identity_at"))
    return join_intervals(events, named, ["device_id"], "event_time", "identity_at", delay, wait, wait)


def counts_sink(path: str, keys: Sequence[str] = ("package_nm", "server_type")) -> BatchFn:
    """Rows of each micro-batch by key with the newest arrival, the running counters' increments.

    The stream's own offsets are the cursor.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*keys).agg(count_rows("log_count"), F.max("reg_dt").alias("last_reg_dt"))
        files.write_batch(counts, path, batch_id, [])

    return write


def snapshot_sink(path: str, build: Callable[[DataFrame], DataFrame]) -> BatchFn:
    """Keep the newest micro-batch's result beside the ones before it; ``read_snapshot`` gives the newest whole one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        files.write_batch(build(batch).withColumn("updated_at", F.current_timestamp()), path, batch_id, [])

    return write


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot. A reader never meets a half-written one: a batch folder appears when it is complete."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar())
