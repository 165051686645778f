import itertools
import random
import zlib

import numpy as np
import pytest
from helpers import clash, docs

from tidemark.llm import quality
from tidemark.llm.queries import QUERIES


def test_marginals_match_enumeration():
    r = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 3])
    odds, t = r.normal(size=10), r.normal(size=(2, 2))
    forward, backward, both = quality.marginals(odds, lengths, t)
    at = 0
    for n in lengths:
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weight[y] = np.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        for i in range(n):
            good = sum(w for y, w in weight.items() if y[i]) / sum(weight.values())
            assert np.isclose(1 / (1 + np.exp(-both[at + i])), good)
        at += n
    assert np.allclose(both, forward + backward)


def good(r):
    return "\n".join(" ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(r.randint(6, 14))) + "." for _ in range(r.randint(1, 6)))


def bad(r):
    return "\n".join(" ".join("".join(r.choices("ABCD", k=5)) + "!!" for _ in range(12)) for _ in range(r.randint(1, 5)))


@pytest.fixture(scope="module")
def fitted():
    r = random.Random(4)
    texts = [good(r) if i % 2 else bad(r) for i in range(240)]
    labels = np.array([float(i % 2) for i in range(240)])
    return quality.fit([quality.line_features(t) for t in texts], labels), r


def test_learns_and_scores_every_text(fitted):
    model, r = fitted
    scores = model.scores([good(r) for _ in range(30)] + [bad(r) for _ in range(30)])
    assert min(scores[:30]) > 0.7 > max(scores[30:])
    edge = model.scores([None, "", "   ", "\n\n", "word " * 200_000, good(r) + "\n" + bad(r)])
    assert all(0 <= s <= 1 for s in edge)
    assert edge[0] == edge[1]
    assert model.scores([]) == []


def test_neighbouring_lines_matter(fitted):
    model, r = fitted
    middle = "abc def ghij kl"
    lines = [quality.line_features("\n".join([f(r).split("\n")[0], middle, f(r).split("\n")[0]])) for f in (good, bad)]
    odds = [model.line_odds(m, np.array([3]))[1] for m, _ in lines]
    assert odds[0] > odds[1]


def test_frames(spark):
    r = random.Random(6)
    rows = [(i, good(r) if i % 2 else bad(r)) for i in range(200)] + [(500, None), (501, ""), (502, good(r)), (502, good(r)), (None, bad(r))]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (777, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(clash(table), labels)
    found = quality.score(clash(table), model).select("doc_id", "score").collect()
    assert len(found) == len(rows)
    assert all((x.score >= 0.7) == bool(x.doc_id % 2) for x in found if x.doc_id is not None and x.doc_id < 200)
    nothing = quality.learn(table, labels.where("false"))
    assert {x.score for x in quality.score(table, nothing).collect()} == {0.5}
    assert quality.score(table.where("false"), model).count() == 0


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    found = QUERIES["op3_quality_crf"](spark, path).toPandas()
    labels = spark.read.parquet(f"{path}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(found) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert ((found.score >= 0.7).astype(int) == found.predicted).all()
    assert (held.predicted == held.quality).mean() >= 0.93
