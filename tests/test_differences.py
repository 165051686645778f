"""Rollups kept up by differences equal the rollup of the rows as they are in the end."""

import collections
import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import rollup
from tidemark.operators.common import DIMS
from tidemark.sources import driver_tables as dtb
from tidemark.sources import files
from tidemark.streaming import differences, streams

SF_DIR = "/root/testdata/sf0.001"
KEYS = ["device_id", "page_id"]


def play(session, arrivals, folder, schema, path, version="version", keys=KEYS):
    """Run the stream over one more file after the other; returns the queries."""
    queries = []
    for frame in arrivals:
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        rows = session.readStream.schema(schema).parquet(str(folder))
        changes = differences.signed_changes(rows, keys, version=version, slots=8)
        query = streams.run_stream(changes, differences.difference_sink(str(path)), "differences", f"{path}-checkpoint", available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        queries.append(query)
    return queries


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def batch_rollup(pages, by):
    return rollup.merge_rollup(rollup.page_daily(pages), by, rollup.rollup_devices(pages, by))


def test_repeated_late_and_corrected_rows(spark, tmp_path):
    session = streams.stateful_session(spark)
    pages = dtb.page_flow(session, SF_DIR).withColumn("version", F.lit(2).cast("long"))
    wrong = pages.withColumns({
        "version": F.lit(1).cast("long"), "page_name": F.concat("page_name", F.lit("/draft")), "intervaltime": F.lit(7).cast("long"),
        "error_count": F.lit(5).cast("long"), "log_date": F.date_sub("log_date", 1), "package_nm": F.lit("other"),
    })
    arrivals = [
        wrong.filter("page_id % 3 = 0").unionByName(pages.filter("page_id % 3 = 1")),  # first versions of a third
        pages.filter("page_id % 3 = 0 OR page_id % 6 = 1"),  # their corrections, and some rows again as they are
        pages.filter("page_id % 3 = 2").unionByName(wrong.filter("page_id % 9 = 0")),  # late rows, and first versions once more
    ]
    path = tmp_path / "roll"
    queries = play(session, arrivals, tmp_path / "in", pages.schema, path)
    by = [*differences.BY]
    same(differences.read_differences(spark, str(path), by), batch_rollup(pages, by))
    same(differences.read_differences(spark, str(path), ["log_date", "page_name"]), batch_rollup(pages, ["log_date", "page_name"]))
    # Each run reads what is new and touches no more entries of state than that.
    for frame, query in zip(arrivals, queries, strict=True):
        progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
        assert sum(p["numInputRows"] for p in progress) == frame.count()
        assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["stateOperators"]) <= frame.count()
    # The third run changed no group of what came again as it was.
    third = spark.read.parquet(f"{path}/parts").filter("batch_id = 2")
    assert third.count() <= pages.filter("page_id % 3 = 2").select(*by).distinct().count()


def test_settled_base_and_later_batches(spark, tmp_path):
    session = streams.stateful_session(spark)
    pages = dtb.page_flow(session, SF_DIR).withColumn("version", F.lit(0).cast("long"))
    path, by = tmp_path / "roll", ["log_date", *DIMS, "page_name"]
    thirds = [pages.filter(f"page_id % 3 = {i}") for i in range(3)]
    for i, frame in enumerate(thirds):
        play(session, [frame], tmp_path / "in", pages.schema, path)
        differences.settle_differences(spark, str(path))
        differences.settle_differences(spark, str(path))
        seen = pages.filter(f"page_id % 3 <= {i}")
        same(differences.read_differences(spark, str(path), by), batch_rollup(seen, by))
    # Batches under the base before the last are gone.
    assert {r.batch_id for r in spark.read.parquet(f"{path}/parts").select("batch_id").distinct().collect()} == {2}
    assert files.exists(spark, f"{path}/base/of=1") and not files.exists(spark, f"{path}/base/of=0")


def test_readers_see_whole_batches_only(spark, tmp_path):
    session = streams.stateful_session(spark)
    pages = dtb.page_flow(session, SF_DIR).withColumn("version", F.lit(0).cast("long"))
    path = tmp_path / "roll"
    with pytest.raises(ValueError):
        differences.read_differences(spark, str(path), ["page_name"])
    play(session, [pages.filter("page_id % 2 = 0")], tmp_path / "in", pages.schema, path)
    # A batch whose parts are written but not its mark counts for nothing; written again it replaces itself.
    half = pages.filter("page_id % 2 = 1").withColumn("sign", F.lit(1))
    files.write_batch(rollup.signed_rollup(half, differences.BY, "sign"), f"{path}/parts", 1, ["log_date"])
    same(differences.read_differences(spark, str(path), ["page_name"]), batch_rollup(pages.filter("page_id % 2 = 0"), ["page_name"]))
    for _ in range(2):
        differences.difference_sink(str(path))(half.select("sign", *differences.IMAGE), 1)
    same(differences.read_differences(spark, str(path), ["page_name"]), batch_rollup(pages, ["page_name"]))


def test_null_keys_ties_and_no_version(spark, tmp_path):
    session = streams.stateful_session(spark)
    base = dtb.page_flow(session, SF_DIR).limit(1).withColumn("page_id", F.lit(None).cast("long"))
    first = base.withColumn("error_count", F.lit(3).cast("long")).unionByName(base.withColumn("error_count", F.lit(3).cast("long")))
    second = base.withColumn("error_count", F.lit(9).cast("long")).withColumn("device_id", F.col("device_id"))
    play(session, [first, second, second], tmp_path / "in", base.schema, tmp_path / "roll", version=None)
    row = differences.read_differences(spark, str(tmp_path / "roll"), ["page_name"]).collect()
    assert [(r.cnt, r.error_count, r.device_count) for r in row] == [(1, 9, 1)]


def test_signed_parts_of_moved_rows_cancel(spark):
    day = dt.date(2024, 1, 2)
    pages = dtb.page_flow(spark, SF_DIR).limit(20).withColumn("log_date", F.lit(day))
    both = pages.withColumn("sign", F.lit(1)).unionByName(pages.withColumn("sign", F.lit(-1)))
    assert rollup.signed_rollup(both, differences.BY, "sign").count() == 0
    assert rollup.signed_devices(both, differences.BY, "sign").count() == 0


class _Handle:
    """State in plain dicts that counts its calls; what was not written for longer than its time to live is gone."""

    def __init__(self):
        self.calls, self.now = 0, 0

    def getMapState(self, name, key, value, ttl=None):
        return _State(self, ttl)

    def getValueState(self, name, value, ttl=None):
        return _State(self, ttl)


class _State:
    def __init__(self, handle, ttl):
        self.handle, self.ttl, self.kept = handle, ttl, {}

    def getValue(self, key):
        self.handle.calls += 1
        at, value = self.kept.get(key, (0, None))
        return value if not self.ttl or self.handle.now < at + self.ttl else None

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.kept[key] = (self.handle.now, value)

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getCurrentProcessingTimeInMs(self):
        return self.handle.now


def test_images_in_pages_give_the_changes_of_single_entries():
    rng, keep = random.Random(3), 1000
    handle, kept, calls = _Handle(), {}, 0
    images = differences._Images(1, ["a", "b"], keep)
    images.init(handle)
    for step, size in enumerate([10, 3000, 3000, 40, 8000, 1]):
        handle.now += 400
        rows = [Row("_key0", "a", "b", "_version", "_rank", "_hash")(
            k, rng.choice(["x", None]), rng.randrange(3), rng.randrange(3), rng.randrange(5), int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:8], signed=True),
        ) for k in [rng.choice([None, rng.randrange(6000)]) for _ in range(size)]]
        want, newest = collections.Counter(), {}
        for r in rows:
            if r[0] not in newest or r[3:5] >= newest[r[0]][3:5]:
                newest[r[0]] = r
        for k, r in newest.items():
            at, version, image = kept.get(k, (-keep, 0, None))
            if at + keep <= handle.now:
                image = None
            if image is not None and (version > r[3] or (version, image) == (r[3], tuple(r[1:3]))):
                continue
            if image != tuple(r[1:3]):
                if image is not None:
                    want[(-1, *image)] += 1
                want[(1, *r[1:3])] += 1
            kept[k] = (handle.now, r[3], tuple(r[1:3]))
        before = handle.calls
        got = collections.Counter(tuple(r) for r in images.handleInputRows((0,), iter(rows), _State(handle, None)))
        assert got == want, step
        # A page is called for once to read and once to write, whatever its rows; splitting pages costs some more.
        assert handle.calls - before <= (2 * size + 2 if size < 100 else size / 10)


def test_state_is_called_by_page_and_not_by_row(spark, tmp_path):
    session = streams.stateful_session(spark)
    rows = session.range(4000).selectExpr("id AS page_id", "concat('d', id % 9) AS device_id", "CAST('2024-01-02' AS DATE) AS log_date")
    one = dtb.page_flow(session, SF_DIR).limit(1).drop("page_id", "device_id", "log_date")
    pages = rows.crossJoin(one).withColumn("version", F.lit(0).cast("long"))
    queries = play(session, [pages], tmp_path / "in", pages.schema, tmp_path / "roll")
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in queries[0].recentProgress]
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["stateOperators"]) <= 4000 / 50
    # Four tasks write one day: a file each at most, and none more for the groups of the state.
    assert len(list((tmp_path / "roll/devices").rglob("*.parquet"))) <= 4
    found = differences.read_differences(spark, str(tmp_path / "roll"), ["page_name"]).collect()
    assert [(r.cnt, r.device_count) for r in found] == [(4000, 9)]
