"""Streams over files, in several micro-batches, equal the batch result."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark import schemas
from tidemark.operators import ingest, session, widgets
from tidemark.operators.common import DIMS
from tidemark.sources import files, topics
from tidemark.sources import driver_tables as dtb
from tidemark.streaming import pages, streams

SF_DIR = "/root/testdata/sf0.001"
BASE = 1704067200000


def event(i, device="d1", kind=131073, mem=1, msg=""):
    fields = {1: BASE + i * 1000, 2: device, 3: kind, 8: mem, 9: 2, 12: f"https://a/{i}", 13: msg, 26: "pkg", 27: 0, 28: "Web"}
    return ",".join(str(fields.get(n, "")) for n in range(1, 43))


def packet_file(folder, name, lines):
    packet = {"key": "a^b^0^PKG", "value": "\n".join(lines), "timestamp": "2024-01-01T01:00:00.000Z"}
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(packet) + "\n")


def run(df, fn, name, tmp_path):
    query = streams.run_stream(df, fn, name, str(tmp_path / f"cp-{name}"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None


def test_packets_to_routed_tables(spark, tmp_path):
    source = tmp_path / "in"
    packet_file(source, "1.json", [event(0), event(1, kind=lt.RESOURCE_START), event(2, kind=lt.SCRIPT_ERROR, msg="boom|at x")])
    packet_file(source, "2.json", [event(0), event(3, kind=lt.CRASH, msg="dead")])
    packets = topics.read_packet_files(spark, str(source), max_files=1)
    run(streams.decode_packets(packets), streams.routed_sink(str(tmp_path / "out")), "routed", tmp_path)
    schema = spark.read.parquet(str(tmp_path / "out/events")).drop("batch_id").schema
    rows = files.read_latest(spark, str(tmp_path / "out/events"), schema, ["log_tm", "device_id", "mem_usage"]).collect()
    assert sorted(r.log_tm for r in rows) == [BASE, BASE + 2000, BASE + 3000]
    assert spark.read.parquet(str(tmp_path / "out/waterfall")).count() == 1
    names = {r.log_name for r in spark.read.parquet(str(tmp_path / "out/trouble")).collect()}
    assert names == {"boom", "dead"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, v int, package_nm string")
    for _ in range(2):
        files.write_batch(df, str(tmp_path / "t"), 7, ["package_nm"], ["id"], "v")
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted((r.id, r.v, r.package_nm) for r in rows) == [("a", 2, "y"), ("b", 1, "z")]


def test_later_batch_wins_and_compaction(spark, tmp_path):
    schema = schemas.ACCESS_HISTORY
    day = dt.date(2024, 1, 2)
    for batch, visits in ((1, 3), (2, 5)):
        df = spark.createDataFrame([(day, "p", 0, "Web", "d", visits, 0, 0)], schema)
        files.write_batch(df, str(tmp_path / "t"), batch)
    keys = ["log_date", *DIMS, "device_id"]
    rows = files._batches(spark, str(tmp_path / "t"), schema, [day])
    assert "PartitionFilters: [log_date" in rows._jdf.queryExecution().executedPlan().toString().replace("isnotnull(log_date#", "log_date")
    other = spark.createDataFrame([(dt.date(2024, 1, 3), "p", 0, "Web", "d", 9, 0, 0)], schema)
    files.write_batch(other, str(tmp_path / "t"), 2)
    for _ in range(2):
        files.compact(spark, str(tmp_path / "t"), str(tmp_path / "done"), schema, keys, day)
        assert [r.visit_cnt for r in spark.read.parquet(str(tmp_path / "done")).collect()] == [5]
    # The settled day's batch folders are gone, the other day's are not; a late row joins what was settled.
    assert [f.day for f in files._day_folders(spark, str(tmp_path / "t"))] == ["2024-01-03"]
    late = spark.createDataFrame([(day, "p", 0, "Web", "late", 1, 0, 0)], schema)
    files.write_batch(late, str(tmp_path / "t"), 3)
    files.compact(spark, str(tmp_path / "t"), str(tmp_path / "done"), schema, keys, day)
    assert sorted(r.visit_cnt for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [1, 5]


def test_expired_days_of_batches_go(spark, tmp_path):
    schema = schemas.ACCESS_HISTORY
    for batch, year in ((1, 2020), (2, 2024)):
        df = spark.createDataFrame([(dt.date(year, 1, 2), "p", 0, "Web", "d", 1, 0, 0)], schema)
        files.write_batch(df, str(tmp_path / "t"), batch)
    assert files.drop_expired_partitions(spark, str(tmp_path / "t"), 4, dt.date(2024, 1, 5)) == ["log_date=2020-01-02"]
    assert [r.batch_id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2]
    assert not (tmp_path / "t" / "batch_id=1").exists()


def test_dead_letters(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")

    def broken(_):
        raise RuntimeError("disk on fire " * 1000)

    assert not files.write_with_dead_letter(df, broken, str(tmp_path / "dead"), 3)
    row = spark.read.parquet(str(tmp_path / "dead")).first()
    assert json.loads(row.row) == {"n": 1, "s": "a"} and row.error == "disk on fire " * 1000 and row.batch_id == 3
    assert files.write_with_dead_letter(df, lambda d: d.count(), str(tmp_path / "dead"))


def test_range_scan_reads_only_its_days(spark, tmp_path):
    events = dtb.event_log(spark, SF_DIR).select("event_id", "log_tm_dt", "package_nm", "server_type", "log_date")
    files.write_partitioned(events, str(tmp_path / "e"))
    found = files.scan_range(spark, str(tmp_path / "e"), events.schema, dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert found.count() == events.filter("log_date BETWEEN '2024-01-03' AND '2024-01-04'").count()
    gone = files.drop_expired_partitions(spark, str(tmp_path / "e"), 4, dtb.AS_OF)
    assert gone[-1] == "log_date=2024-01-25"
    left = spark.read.parquet(str(tmp_path / "e"))
    assert left.count() == files.apply_retention(events, "log_date", 4, dtb.AS_OF).count()


def split_files(df, folder, col, parts):
    """Write a frame as files in order of time, one per micro-batch."""
    rows = df.orderBy(col)
    edges = rows.approxQuantile(col, [i / parts for i in range(1, parts)], 0.0)
    bounds = [float("-inf"), *edges, float("inf")]
    for i in range(parts):
        part = df.filter((F.col(col) > bounds[i]) & (F.col(col) <= bounds[i + 1]))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark_stream(df, folder)


def spark_stream(df, folder):
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def page_events(spark, rows):
    """Events (id, ms, device, type) with the columns of the page builder."""
    df = spark.createDataFrame(rows, "event_id long, log_tm long, device_id string, log_type long")
    return df.withColumns(
        {
            "log_tm_dt": F.timestamp_millis("log_tm"), "package_nm": F.lit("p"), "server_type": F.lit(0).cast("long"), "os_type": F.lit("Web"), "app_ver": F.lit("1"),
            "device_model": F.lit("m"), "user_id": F.concat(F.lit("u"), "event_id"), "req_url": F.concat(F.lit("/"), "event_id"), "cpu_usage": F.lit(1).cast("long"),
            "mem_usage": F.lit(1).cast("long"),
        }
    )


# A row of another device far ahead lets the watermark pass all rows before it.
FLUSH = (10**6, 2 * BASE, "flush", lt.WEB_START)


def stream_pages(df, folder, parts, by, tmp_path, idle_ms=10**13):
    split_files(df, folder, by, parts)
    by_entry = streams.stateful_session(df.sparkSession).readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = by_entry.drop("_at").withWatermark("log_tm_dt", "10 minutes")
    run(pages.build_pages_stream(stream, idle_ms=idle_ms), streams.table_sink(str(tmp_path / "built"), ["log_date"]), "pages", tmp_path)
    return df.sparkSession.read.parquet(str(tmp_path / "built")).drop("batch_id")


def same_rows(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def all_but_last(batch):
    last = batch.groupBy("device_id").agg(F.max("page_no").alias("_last"))
    return batch.join(last, "device_id").filter("page_no < _last").drop("_last")


def test_stream_pages_equal_batch_pages(spark, tmp_path):
    events = dtb.event_log(spark, SF_DIR).withColumn("cpu_usage", F.col("k").cast("long")).withColumn("mem_usage", (F.col("k") * 10).cast("long"))
    shape = page_events(spark, [FLUSH])
    events = events.select(*shape.columns)
    got = stream_pages(events.unionByName(shape), tmp_path / "events", 4, "log_tm", tmp_path)
    same_rows(got, all_but_last(session.build_pages(events)))


def test_late_openers_and_repeated_rows(spark, tmp_path):
    kinds = [lt.WEB_START, lt.WEB_CLICK, lt.SCRIPT_ERROR, lt.WEB_END]
    rows = [(i, BASE + i * 20_000, f"d{i % 3}", kinds[i * 7 % 4]) for i in range(90)]
    events = page_events(spark, [*rows, FLUSH])
    # Arrival: out of order by up to eight minutes, and every fifth row once more a little later.
    jitter = F.col("log_tm") + F.col("event_id") * 7919 % 480_000
    arriving = events.withColumn("_at", F.when(F.col("event_id") == FLUSH[0], F.lit(3 * BASE)).otherwise(jitter))
    arriving = arriving.unionByName(arriving.filter("event_id % 5 = 0 AND event_id < 1000").withColumn("_at", F.col("_at") + 30_000))
    got = stream_pages(arriving, tmp_path / "late", 6, "_at", tmp_path)
    same_rows(got, all_but_last(session.build_pages(page_events(spark, rows))))


def test_idle_pages_close_by_timeout(spark, tmp_path):
    hour = 3_600_000
    rows = [(1, BASE, "a", lt.WEB_START), (2, BASE + 1000, "a", lt.WEB_END), (3, BASE + 2 * hour, "b", lt.WEB_START), (4, BASE + 4 * hour, "b", lt.WEB_START), (5, BASE + 6 * hour, "a", lt.WEB_START), FLUSH]
    got = {(r.device_id, r.page_start_tm): r for r in stream_pages(page_events(spark, rows), tmp_path / "idle", 4, "log_tm", tmp_path, 30 * 60_000).collect()}
    first = got["a", BASE]
    assert (first.loading_time, first.log_count, first.page_no, first.user_id) == (1000, 2, 1, "u1")
    assert {k: r.page_no for k, r in got.items()} == {("a", BASE): 1, ("a", BASE + 6 * hour): 2, ("b", BASE + 2 * hour): 1, ("b", BASE + 4 * hour): 2}


def test_a_batch_of_one_device_writes_its_own_rows_of_state(spark, tmp_path):
    day = 86_400_000
    rows = [(i, BASE + i * 1000, f"d{i % 20}", lt.WEB_START if i < 20 else lt.WEB_CLICK) for i in range(400)]
    first, second = page_events(spark, rows), page_events(spark, [(1000 + i, BASE + 400_000 + i, "d3", lt.WEB_CLICK) for i in range(5)])
    session = streams.stateful_session(spark)
    updated = []
    for frame in (first, second):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(frame.schema).parquet(str(tmp_path / "in")).withWatermark("log_tm_dt", "1 day")
        query = streams.run_stream(pages.build_pages_stream(stream, idle_ms=day), streams.table_sink(str(tmp_path / "out"), ["log_date"]), "own", str(tmp_path / "cp"), available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        with_rows = [p for p in query.recentProgress if p["numInputRows"]]
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in with_rows))
    # Each row is an entry; beside them a device has its page and its timer. The second run writes for one device only.
    assert updated[0] >= 400 and updated[1] <= 5 + 4


def arriving(spark, rows):
    """Rows of (key, event minute, arrival minute)."""
    df = spark.createDataFrame(rows, "event_id long, at long, came long")
    return df.withColumns({"log_tm_dt": F.timestamp_millis(BASE + F.col("at") * 60_000), "reg_dt": F.timestamp_millis(BASE + F.col("came") * 60_000)})


def test_dedup_before_the_sink(spark, tmp_path):
    rows = [(i, i, i + i % 4) for i in range(60)]
    copies = [(i, at, came + 3) for i, at, came in rows if i % 5 == 0] + [(i, at, came + 1) for i, at, came in rows if i % 7 == 0]
    odd = [(100, 1, 30), (101, 50, 40), (102, 2, 59), (100, 1, 31)]  # late, ahead of its time, late, late again
    df = arriving(spark, [*rows, *copies, *odd, (103, 900, 900)]).unionByName(arriving(spark, [(104, 5, 6)]).withColumn("log_tm_dt", F.lit(None).cast("timestamp")))
    stream = split_files(df.withColumn("_came", F.col("came").cast("double")), tmp_path / "in", "_came", 5).drop("_came")
    sinks = [streams.table_sink(str(tmp_path / name), []) for name in ("once", "late")]
    for query in streams.run_deduplicated(stream, ["event_id"], "log_tm_dt", "reg_dt", "10 minutes", "5 minutes", *sinks, "dedup", str(tmp_path / "cp"), available_now=True):
        query.awaitTermination(120)
        assert query.exception() is None
    once = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "once")).collect())
    assert once == [*range(60), 103]
    late = sorted((r.event_id, r.came) for r in spark.read.parquet(str(tmp_path / "late")).collect())
    assert late == [(100, 30), (100, 31), (101, 40), (102, 59), (104, 6)]


def test_session_windows_with_late_rows(spark, tmp_path):
    gap = 30 * 60_000
    minutes = {"a": [0, 10, 40, 71, 200, 230], "b": [0, 31, 62, 93], "c": [5, 5, 35, 65], "d": [1000]}
    rows = [(d, BASE + m * 60_000, i) for d, ms in minutes.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "device_id string, page_start_tm long, page_id long").withColumns({
        "package_nm": F.lit("p"), "page_end_tm": F.col("page_start_tm") + 500, "log_type": F.lit(lt.WEB_START).cast("long"), "req_url": F.lit("/"),
        # Pages come in three batches; some that join two sessions come last.
        "_at": F.when(F.col("page_id") % 2 == 1, F.lit(2.0)).otherwise(F.lit(1.0)),
    })
    flush = df.limit(1).withColumns({"device_id": F.lit("flush"), "page_start_tm": F.lit(2 * BASE), "_at": F.lit(3.0)})
    stream = split_files(df.unionByName(flush), tmp_path / "in", "_at", 3).drop("_at")
    run(streams.session_stream(stream, gap, "5 hours"), streams.table_sink(str(tmp_path / "out"), []), "sessions", tmp_path)
    got = {(r.device_id, r.parent_log_date): (r.page_count, r.last_page_tm) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = session.sessionize(df.drop("_at"), gap, starters=()).groupBy("device_id", "parent_log_date").agg(F.count(F.lit(1)).alias("n"), F.max("page_start_tm").alias("last"))
    assert got == {(r.device_id, r.parent_log_date): (r.n, r.last) for r in batch.collect()}
    assert {k[1] for k in got if k[0] == "b"} == {BASE + m * 60_000 for m in minutes["b"]}


def test_increment_keeps_the_newest_row(spark, tmp_path):
    # Rows of a key come in any order over the batches; the first batch of key 3 holds its newest row.
    rows = [(i % 20, BASE + i, i) for i in range(60)] + [(3, BASE + 500, 999), (3, BASE + 1, 1000)]
    df = spark.createDataFrame(rows, "event_id long, log_tm long, n long")
    stream = split_files(df, tmp_path / "dups", "n", 3)
    run(stream, streams.increment_sink(str(tmp_path / "inc"), ["event_id"], "log_tm"), "increment", tmp_path)
    got = streams.read_increment(spark, str(tmp_path / "inc"), df.schema, ["event_id"], "log_tm").collect()
    newest = {}
    for key, ms, n in rows:
        newest[key] = max(newest.get(key, (0, 0)), (ms, n))
    assert {r.event_id: (r.log_tm, r.n) for r in got} == newest


@pytest.mark.parametrize("parts", [2, 5])
def test_samples_merge_to_that_of_all_rows(spark, tmp_path, parts):
    df = spark.range(3000).selectExpr("id AS event_id", "cast(id * 37 % 1700 AS bigint) AS ms", "if(id % 4 = 0, 'a', 'b') AS package_nm", "0L AS server_type", "cast(id * 7919 % 3000 AS double) AS _at")
    twice = df.unionByName(df.filter("event_id % 5 = 0").withColumn("_at", F.lit(5000.0)))
    run(split_files(twice, tmp_path / "in", "_at", parts).drop("_at"), streams.sample_sink(str(tmp_path / "s"), "ms", ["event_id"], cap=200), "sample", tmp_path)
    got = streams.read_sample(spark, str(tmp_path / "s"), df.drop("_at").schema, "ms", ["event_id"], cap=200)
    want = widgets.scatter_sample(df.drop("_at"), "ms", "", ["event_id"], cap=200)
    same_rows(got, want)
    assert want.filter("ms < 1500").count() == 400


def test_identities_and_events_in_either_order(spark, tmp_path):
    """Events and identity rows up to an hour apart meet, whichever comes first; events without one come out in the end."""
    minute = 60_000
    events = [(i, f"d{i % 7}", i * 10) for i in range(60)]
    named = [(f"d{d}", f"u{d}", d * 45 + 100 * k) for d in range(5) for k in range(3)] + [("d5", " ", 50)]
    e = spark.createDataFrame([(i, d, BASE + m * minute) for i, d, m in events], "event_id long, device_id string, ms long")
    n = spark.createDataFrame([(d, u, BASE + m * minute) for d, u, m in named], "device_id string, user_id string, ms long")
    both = e.selectExpr("event_id", "device_id", "'' AS user_id", "ms").unionByName(n.selectExpr("-1L AS event_id", "device_id", "user_id", "ms"))
    # Half the identities come before all events, the others after them.
    both = both.withColumn("_at", F.when(F.col("event_id") >= 0, F.lit(2.0)).when(F.col("device_id").isin("d0", "d2", "d4"), F.lit(1.0)).otherwise(F.lit(3.0)))
    far = spark.createDataFrame([(10**6, "far", "", 2 * BASE, 4.0), (-1, "far", "x", 2 * BASE, 4.0)], both.schema)
    every = both.unionByName(far)
    for arrival in (1.0, 2.0, 3.0, 4.0):
        every.filter(F.col("_at") == arrival).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark_stream(every, tmp_path / "in").drop("_at").withColumn("at", F.timestamp_millis("ms"))
    left = stream.filter("event_id >= 0").select("event_id", "device_id", F.col("at").alias("event_time"))
    right = stream.filter("event_id < 0").select("device_id", "user_id", F.col("at").alias("updated_at"))
    run(streams.late_identities(left, right, "20 days", "1 hour"), streams.table_sink(str(tmp_path / "out"), []), "identities", tmp_path)
    got = sorted((r.event_id, r.mapped_user or "") for r in spark.read.parquet(str(tmp_path / "out")).filter("device_id <> 'far'").collect())
    want = []
    for i, d, m in events:
        users = [u for who, u, at in named if who == d and u.strip() and abs(at - m) <= 60]
        want += [(i, u) for u in users] or [(i, "")]
    assert got == sorted(want) and any(u for _, u in want) and any(not u for _, u in want)


def test_counts_of_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, BASE + i) for i in range(60)], "event_id long, log_tm long").withColumns(
        {"reg_dt": F.timestamp_millis("log_tm"), "package_nm": F.lit("p"), "server_type": F.lit(0)}
    )
    run(split_files(df, tmp_path / "rows", "log_tm", 3), streams.counts_sink(str(tmp_path / "counts")), "counts", tmp_path)
    assert spark.read.parquet(str(tmp_path / "counts")).agg(F.sum("log_count")).first()[0] == 60


def test_stream_needs_a_checkpoint(spark, tmp_path):
    stream = split_files(spark.range(3).withColumnRenamed("id", "n"), tmp_path / "x", "n", 2)
    try:
        streams.run_stream(stream, lambda b, i: None, "none", "")
    except ValueError:
        return
    raise AssertionError("a stream without a checkpoint was started")


def test_snapshot_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([(i, BASE + i) for i in range(9)], "n long, log_tm long")
    stream = split_files(df, tmp_path / "snap", "log_tm", 3)
    sink = streams.snapshot_sink(str(tmp_path / "now"), lambda b: b.agg(F.max("n").alias("top")))
    run(stream, sink, "snapshot", tmp_path)
    row = streams.read_snapshot(spark, str(tmp_path / "now")).collect()
    assert len(row) == 1 and row[0].top == 8


def test_topic_options():
    options = topics.topic_options("b:9092", "total-logs", 500, "earliest", [0, 2])
    assert options["assign"] == '{"total-logs":[0,2]}' and options["maxOffsetsPerTrigger"] == "500"
    assert options["failOnDataLoss"] == "true"
    assert topics.topic_options("b:9092", "t", 9)["subscribe"] == "t"
    assert topics.topic_options("b:9092", "t", 9, fail_on_data_loss=False)["failOnDataLoss"] == "false"


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(6000).selectExpr("id", "id % 1400 AS ms", "'p' AS package_nm", "0 AS server_type")
    a = widgets.scatter_sample(df, "ms", "id", ["id"], cap=1200)
    b = widgets.scatter_sample(df.repartition(7), "ms", "id", ["id"], cap=1200)
    assert a.count() == 1200 and {r.id for r in a.collect()} == {r.id for r in b.collect()}


def test_trouble_of_a_stream_batch(spark):
    df = spark.createDataFrame([(lt.CRASH, None), (lt.WEB_START, "x")], "log_type long, res_msg string")
    assert [r.log_name for r in ingest.derive_trouble(df).collect()] == [None]
