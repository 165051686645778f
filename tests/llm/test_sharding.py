import collections
import math
import zlib

import pytest
import xxhash
from helpers import clash, docs
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.queries import QUERIES


def plain_shard(key, weights):
    """The law again, from its hash: XXH64 of the id's and then the shard number's bytes."""
    bids = []
    for shard, weight in enumerate(weights):
        seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed)
        bids.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, shard))
    return min(bids)[1]


def test_matches_plain_law(spark):
    weights = [1.0, 2.0, 0.5, 1.0, 4.0]
    ids = [*range(0, 4000, 7), -5, 2**62, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", sharding.shard_of([F.col("doc_id")], weights).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: plain_shard(i, weights) for i in ids}


def test_weights_set_shares_and_growth_moves_few(spark):
    weights = [1.0, 2.0, 3.0, 2.0]
    keys = spark.range(40_000).select(
        sharding.shard_of([F.col("id")], weights).alias("a"), sharding.grown_shard_of([F.col("id")], weights, 2.0).alias("b"),
    )
    rows = keys.collect()
    shares = collections.Counter(r.a for r in rows)
    assert all(abs(shares[s] / 40_000 - w / 8) < 0.02 for s, w in enumerate(weights))
    moved = [r.b for r in rows if r.a != r.b]
    assert set(moved) == {4} and abs(len(moved) / 40_000 - 0.2) < 0.02


def test_bad_weights():
    for weights in ([], [1.0, 0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.shard_of([F.lit(1)], weights)


def test_slots_are_gapless_with_a_hot_key(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(7, "hot")] * 400 + [(None, None)] * 5
    table = clash(docs(spark, rows)).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("c"), sharding.shard_of([F.col("doc_id")], [1.0] * 6).alias("shard"))
    got = sharding.with_slots(table, "shard", ["doc_id"]).collect()
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert sharding.with_slots(table.where("false"), "shard", ["doc_id"]).count() == 0


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    query = QUERIES["op7_rendezvous_shards"](spark, path)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    found = query.collect()
    assert len(found) == len(texts)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, [1.0] * 24), plain_shard(r.doc_id, [1.0] * 25))
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
