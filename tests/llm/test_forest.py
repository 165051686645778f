import numpy as np
import pytest
from helpers import groups

from tidemark.llm import forest
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, cosine=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    order = np.argsort(ids)
    group = groups(len(ids), [(int(a), int(b)) for a, b in zip(*np.nonzero(near[np.ix_(order, order)]))])
    component = {int(ids[order[i]]): int(ids[order[g]]) for i, g in enumerate(group)}
    return {int(i): int(n) for i, n in zip(ids, near.sum(axis=1))}, component


def clusters(seed, n, dim, groups_of):
    r = np.random.default_rng(seed)
    parts = [r.normal(size=(n, dim))]
    for size, noise in groups_of:
        parts.append(r.normal(size=dim) + noise * r.normal(size=(size, dim)))
    return np.vstack(parts).astype(np.float32)


@pytest.mark.parametrize("leaf", [16, 64])
def test_links_found_match_all_pairs(spark, leaf, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "BLOCK", 50)  # full leaves are compared in several blocks
    monkeypatch.setattr(forest.grow, "__defaults__", (leaf, forest.SPILL, forest.COSINE))
    vectors = clusters(1, 500, 32, [(150, 0.1), (20, 0.2), (20, 0.3), (5, 0.01)])
    ids = np.random.default_rng(2).permutation(len(vectors)) * 3
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)], SCHEMA)
    found = {r.vec_id: r for r in forest.near_vectors(table).collect()}
    links, component = brute(ids, vectors.astype(float))
    assert sum(r.n_links for r in found.values()) >= 0.97 * sum(links.values()) > 0
    assert all(r.n_links <= links[i] for i, r in found.items())  # none below the threshold, none counted twice
    agree = sum(found[i].component_id == c for i, c in component.items())
    assert agree >= 0.98 * len(component)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_copies_and_unusable_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (3, a), (9, a), (4, b), (7, c), (1, None), (2, []), (6, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (10, [float("nan"), 1.0, 0.0]), (11, [float("inf"), 0.0, 0.0]), (12, [1.0, 0.0]), (13, [2.0, 0.0]), (None, c)]
    table = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).selectExpr("*", "'x' AS id", "1 AS n", "2 AS tree", "3 AS vec")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_vectors(table).collect()}
    assert found == {
        5: (3, 3, False), 3: (3, 3, True), 9: (3, 3, False), 4: (3, 3, False), 7: (1, 7, True), None: (1, 7, False), 1: (0, 1, True), 2: (0, 2, True), 6: (0, 6, True),
        8: (0, 8, True), 10: (0, 10, True), 11: (0, 11, True), 12: (1, 12, True), 13: (1, 12, False),
    }
    assert forest.near_vectors(table.where("false")).count() == 0
    assert forest.near_vectors(table.where("vec_id = 6")).count() == 1


def test_every_vector_reaches_a_leaf_and_deep_trees_use_ancestors():
    r = np.random.default_rng(3)
    sample = forest._unit(r.normal(size=(512, 16)))
    tree = forest.grow(sample, 200_000, 0, 64)
    assert len(tree.directions) == 12 and tree.own == 5
    rows, leaves = tree.route(forest._unit(r.normal(size=(5000, 16))))
    assert set(rows.tolist()) == set(range(5000))
    sizes = np.bincount(leaves, minlength=1 << 12)
    assert (sizes > 0).mean() > 0.5 and sizes.max() < 5000 * 0.05
    rows, leaves = forest.grow(sample, 1, 0).route(sample)
    assert leaves.tolist() == [0] * 512


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    found = {r.vec_id: r for r in QUERIES["op9_embedding_forest"](spark, path).collect()}
    links, _ = brute(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float))
    assert {i: r.n_links for i, r in found.items()} == links


def dense_third(r, n, dim=64):
    """Vectors of which a third lies in one group at about 0.92 to each other, a sixth in groups of 50, and the rest alone or in pairs."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    about = lambda centre, cosine: unit(np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * unit(r.normal(size=centre.shape)))
    group = about(np.repeat(unit(r.normal(size=(1, dim))), n // 3, axis=0), 0.92)
    small = about(np.repeat(unit(r.normal(size=(n // 300, dim))), 50, axis=0), 0.95)
    alone = unit(r.normal(size=(n // 4, dim)))
    return group, small, alone, about(alone, 0.93)


@pytest.mark.parametrize("depth", [6, 12, 14])
def test_recall_stays_with_depth_and_copies_stay_bounded(depth):
    r = np.random.default_rng(depth)
    sample = np.concatenate(dense_third(r, forest.SAMPLE))
    trees = [forest.grow(sample, forest.LEAF << depth, t) for t in range(forest.TREES)]
    assert len(trees[0].directions) == depth
    r = np.random.default_rng([depth, 1])
    group = sample[r.permutation(forest.SAMPLE // 3)[:150]]
    alone = r.normal(size=(150, 64))
    alone /= np.linalg.norm(alone, axis=1, keepdims=True)
    other = np.sqrt(0.92) * alone + np.sqrt(0.08) * r.normal(size=alone.shape) / 8
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    every = np.concatenate([group, alone, other])
    met, copies = np.zeros((len(every),) * 2, bool), np.zeros(len(every))
    for tree in trees:
        rows, leaves = tree.route(every)
        copies += np.bincount(rows, minlength=len(every))
        held = leaves[:, None] == np.unique(leaves)
        holds = np.zeros((len(every), held.shape[1]), bool)
        np.logical_or.at(holds, rows, held)
        met |= (holds.astype(np.float32) @ holds.T.astype(np.float32)) > 0
    links = every @ every.T >= 0.9
    np.fill_diagonal(links, False)
    assert met[:150, :150][links[:150, :150]].mean() >= 0.98
    assert met[150:, 150:][links[150:, 150:]].mean() >= 0.98
    assert copies.mean() <= 60


def test_table_with_a_dense_group(spark):
    """Links of ids divisible by 100, and all components, against all pairs."""
    vectors = np.concatenate(dense_third(np.random.default_rng(8), 6000)).astype(np.float32)
    ids = np.random.default_rng(9).permutation(len(vectors))
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)], SCHEMA)
    found = {r.vec_id: r for r in forest.near_vectors(table).collect()}
    links, component = brute(ids, vectors.astype(float))
    asked = [i for i in links if i % 100 == 0]
    assert sum(found[i].n_links for i in asked) >= 0.98 * sum(links[i] for i in asked) > 10_000
    assert all(r.n_links <= links[i] for i, r in found.items())
    assert sum(found[i].component_id == c for i, c in component.items()) >= 0.99 * len(component)
