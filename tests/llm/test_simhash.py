import random

import numpy as np
import pytest
import xxhash
from helpers import clash, docs, groups

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n\t ", "One", "one two", "A B C", "a b c a b c a b c", "É x y z É", "a  b\x0bc\x1cd e", "w " * 70_000 + "end"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints_match_plain_ones(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def brute(fps, distance=3):
    fps = np.array(fps, np.uint64)
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(fps[i] ^ fps) <= distance)[0] if j > i]
    return groups(len(fps), pairs)


def linked(spark, fps):
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = components(simhash.link(frame), "a", "b")
    return {r.node: r.component for r in found.collect()}


@pytest.mark.parametrize("kind", ["spread", "ball", "sparse"])
def test_links_match_all_pairs(spark, kind, monkeypatch):
    r = random.Random(kind)
    if kind == "spread":
        fps = [r.getrandbits(64) for _ in range(400)]
        fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for f in fps for _ in range(2)]
    elif kind == "ball":  # one dense group that fills a bucket beyond what a join pairs, in several blocks
        monkeypatch.setattr(simhash, "JOINED", 16)
        monkeypatch.setattr(simhash, "BLOCK", 40)
        centre = r.getrandbits(64)
        fps = [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for _ in range(500)] + [1 << 63, 0, (1 << 64) - 1]
    else:  # correlated bits, many ties
        fps = [sum(1 << b for b in r.sample(range(20), 5)) for _ in range(400)]
    fps = sorted(set(fps))
    got, want = linked(spark, fps), brute(fps)
    of = {}
    for i, f in enumerate(fps):
        of.setdefault(got.get(simhash._signed(f), simhash._signed(f)), set()).add(i)
    expected = {}
    for i, g in enumerate(want):
        expected.setdefault(g, set()).add(i)
    assert sorted(map(sorted, of.values())) == sorted(map(sorted, expected.values()))


def test_thresholds_keep_the_pigeonhole_sum():
    r = np.random.default_rng(1)
    for total in (10, 10_000, 10**9, 10**12):
        parts = simhash.plan_parts([int(x) for x in r.integers(-(2**63), 2**63 - 1, 300)], total)
        bits = [b for p in parts for b in p.bits]
        assert len(bits) == len(set(bits))
        left_out = (64 - len(bits) + 63) // 64
        assert sum(p.threshold for p in parts) - left_out >= 3 - (len(parts) + left_out) + 1


@pytest.mark.parametrize("total", [0, 1, 2, 50, 10**6, 10**12])
@pytest.mark.parametrize("sample", [[], [5], [5, -9], [7, 8, 8, 8]])
def test_plans_stay_small(sample, total):
    for distance in (0, 1, 3, 5):
        parts = simhash.plan_parts(sample, total, distance)
        assert parts and all(len(p.probes()) <= 2 * simhash.PROBES for p in parts)


def test_no_and_one_fingerprint(spark):
    frame = spark.createDataFrame([(5,), (5,), (None,)], "fp long")
    assert simhash.link(frame).count() == 0
    assert simhash.link(frame.where("false")).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (2000, 2000), (None, 3), (5000, 4999), (4999, 5000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(frame, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 301), 1), **dict.fromkeys(range(1000, 1200), 1000), 4999: 4999, 5000: 4999}
    assert components(frame.where("false"), "a", "b").count() == 0


def test_frames(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
    rows = [(10, base), (4, base), (4, base), (7, base.upper()), (3, None), (2, ""), (8, " "), (9, "quite another text of its own"), (None, base), (None, "alone by itself and nameless"), (None, "another one without any name"), (9, "a second text under one id, which joins no group")]
    table = clash(docs(spark, rows))
    found = simhash.near_duplicates(table).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert by_id == {10: 4, 4: 4, 7: 4, 3: 2, 2: 2, 8: 2, 9: 9}
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["4", "None", "None"]
    kept = simhash.keep_first(table, simhash.near_duplicates(table))
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "9", "9", "None", "None"]
    assert simhash.near_duplicates(table.where("false")).count() == 0


def test_rows_with_maps(spark):
    table = docs(spark, [(1, "one and the same"), (1, "one and the same"), (2, "one and the same"), (3, "another text, far from it")]).selectExpr("*", "map('a', doc_id) AS extra", "array(1.5) AS more")
    kept = simhash.keep_first(table, simhash.near_duplicates(table))
    assert kept.columns == table.columns and sorted((r.doc_id, r.extra["a"]) for r in kept.collect()) == [(1, 1), (3, 3)]


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = QUERIES["op6_simhash"](spark, path).orderBy("doc_id").collect()
    fps = [plain_fingerprint(texts[r.doc_id]) for r in found]
    assert [r.fingerprint for r in found] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in found] == [found[g].doc_id for g in brute(fps)]
