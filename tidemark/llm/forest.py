"""Near-duplicate embeddings by a random-projection tree forest with spill."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut
from tidemark.llm.components import components

TREES = 12
LEAF = 256  # distinct vectors a leaf is meant to hold
SPILL = 0.05  # share of a node's vectors on either side of the split that go both ways at least
REACH = 0.35  # and all that lie nearer to the split than this part of how far linked vectors differ along a random direction
SAMPLE = 1 << 14  # vectors that set the split points
FEW = 16  # sampled vectors a node needs to be split by its own
DENSE = 0.25  # share of a node's pairs that link from which the node is left whole: its comparisons are four times its links at most
LOOKED_AT = 64  # sampled vectors of a node that tell
BLOCK = 1024  # vectors on either side of a comparison
COSINE = 0.9
SEED = 20_240_611


@dataclass(frozen=True)
class Tree:
    """A direction a level, and for each node of a level where the lower side begins to spill, and where the upper ends to.

    A node whose vectors mostly link with each other is not split: both bounds are infinite, and all its vectors go down together.
    From level ``own`` on nodes are too small in the sample; their splits come from the ancestor at that level, along the
    new level's direction, so a tree can be deeper than its sample and stays as small.
    """

    directions: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    own: int

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves of vectors; a row may reach several leaves."""
        rows = np.arange(len(unit))
        node = np.zeros(len(unit), np.int64)
        along = unit @ self.directions.T if len(self.directions) else None
        for level in range(len(self.directions)):
            at = node >> max(0, level - self.own)
            value = along[rows, level]
            up = value >= self.low[level][at]
            down = (value < self.high[level][at]) | ~up
            rows, node = np.concatenate([rows[down], rows[up]]), np.concatenate([2 * node[down], 2 * node[up] + 1])
        return rows, node


def _dense(sample: np.ndarray, order: np.ndarray, bounds: np.ndarray, cosine: float) -> np.ndarray:
    """Which nodes have so many links among their sampled vectors that they stay whole."""
    out = np.zeros(len(bounds) - 1, bool)
    for node in np.flatnonzero(np.diff(bounds) >= FEW // 2):
        begin, end = bounds[node], bounds[node + 1]
        some = sample[order[begin: end: max(1, (end - begin) // LOOKED_AT)]]
        near = (some @ some.T >= cosine)[np.triu_indices(len(some), 1)]
        out[node] = near.mean() >= DENSE
    return out


def grow(sample: np.ndarray, total: int, number: int, leaf: int = LEAF, spill: float = SPILL, cosine: float = COSINE) -> Tree:
    """Tree ``number`` for ``total`` vectors, split at the medians of a sample of unit vectors."""
    depth = max(0, int(np.ceil(np.log2(max(1, total / leaf)))))
    own = min(depth, max(0, int(np.floor(np.log2(max(1, len(sample) / FEW))))))
    directions = np.random.default_rng([SEED, number]).normal(size=(depth, sample.shape[1]))
    along = sample @ directions.T
    reach = REACH * np.sqrt(max(0.0, 2 - 2 * cosine) / max(1, sample.shape[1])) * np.linalg.norm(directions, axis=1)
    node = np.zeros(len(sample), np.int64)
    low, high = [], []
    for level in range(depth):
        count = 1 << min(level, own)
        order = np.lexsort((along[:, level], node))
        bounds = np.searchsorted(node[order], np.arange(count + 1))
        sorted_along = np.append(along[order, level], 0.0)
        size = np.diff(bounds)

        def at(share: float, begin=bounds[:-1], size=size, values=sorted_along) -> np.ndarray:
            place = begin + np.minimum((size * share).astype(np.int64), np.maximum(size - 1, 0))
            return np.where(size > 0, values[np.minimum(place, len(values) - 1)], 0.0)

        whole = _dense(sample, order, bounds, cosine)
        middle = np.where(whole, np.inf, at(0.5))
        low.append(np.where(whole, np.inf, np.minimum(at(0.5 - spill), middle - reach[level])))
        high.append(np.where(whole, np.inf, np.maximum(at(0.5 + spill), middle + reach[level])))
        if level < own:
            node = 2 * node + (along[:, level] >= middle[node])
    return Tree(directions, low, high, own)


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _table(rows: np.ndarray, leaves: np.ndarray, n: int, fill: int) -> np.ndarray:
    """Leaves of each row side by side."""
    order = np.lexsort((leaves, rows))
    rows, leaves = rows[order], leaves[order]
    head = np.searchsorted(rows, np.arange(n))
    place = np.arange(len(rows)) - head[rows]
    out = np.full((n, int(place.max(initial=0)) + 1), fill, np.int64)
    out[rows, place] = leaves
    return out


def _leaf_lists(tree: Tree, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different lists of leaves among the vectors, and which of them each vector has."""
    rows, leaves = tree.route(unit)
    lists, which = np.unique(_table(rows, leaves, len(unit), -1), axis=0, return_inverse=True)
    return lists, which.reshape(-1)


def _first_meeting(trees: list[Tree], tree: int, leaf: int, unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair's first common leaf, by tree and then by leaf, is this one. Pairs whose lists of leaves are the same are settled once."""
    first = np.ones(len(a), bool)
    if not len(a):
        return first
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a):]
    for t in range(tree + 1):
        lists, which = _leaf_lists(trees[t], unit[used])
        kinds, of = np.unique(which[a] * len(lists) + which[b], return_inverse=True)
        ok = np.empty(len(kinds), bool)
        for k in range(0, len(kinds), 1 << 15):
            left, right = lists[kinds[k:k + (1 << 15)] // len(lists)], lists[kinds[k:k + (1 << 15)] % len(lists)]
            common = (left[:, :, None] == right[:, None, :]) & (left[:, :, None] >= 0)
            if t < tree:
                ok[k:k + (1 << 15)] = ~common.any(axis=(1, 2))
            else:
                ok[k:k + (1 << 15)] = np.where(common, left[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2)) == leaf
        first &= ok[of]
    return first


def _met_before(trees: list[Tree], tree: int, unit: np.ndarray) -> np.ndarray:
    """Vectors of a large leaf that an earlier tree has in one leaf together, as many as any does; their pairs were compared there."""
    best = np.zeros(len(unit), bool)
    for t in range(tree):
        rows, leaves = trees[t].route(unit)
        found, counts = np.unique(leaves, return_counts=True)
        if counts.max() > best.sum():
            best = np.zeros(len(unit), bool)
            best[rows[leaves == found[np.argmax(counts)]]] = True
    return best


def _compare(trees_of: dict[int, list[Tree]], rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one block: for each vector the number of rows it links to here first, and a vector of its linked group."""
    tree, leaf, i, j = (int(rows[c].iloc[0]) for c in ("tree", "leaf", "i", "j"))
    unit = _unit(rows["vec"])
    block = rows["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    trees = trees_of[unit.shape[1]]
    near = np.zeros((len(left), len(right)), bool)
    met = _met_before(trees, tree, unit) if len(rows) > LEAF * 2 else np.zeros(len(rows), bool)
    fresh = ~met[right]
    near[:, fresh] = unit[left] @ unit[right[fresh]].T >= cosine
    late = ~met[left]
    near[np.ix_(late, ~fresh)] = unit[left[late]] @ unit[right[~fresh]].T >= cosine
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    first = _first_meeting(trees, tree, leaf, unit, a, b)
    copies = rows["n"].to_numpy(np.int64)
    links = np.bincount(a[first], copies[b[first]], len(rows)) + np.bincount(b[first], copies[a[first]], len(rows))
    group = np.arange(len(rows))
    while True:
        least = group.copy()
        np.minimum.at(least, a, group[b])
        np.minimum.at(least, b, group[a])
        least = np.minimum(least, least[least])
        if np.array_equal(least, group):
            break
        group = least
    ids = rows["id"].to_numpy(np.int64)
    out = np.unique(np.concatenate([a, b]))
    return pd.DataFrame({"id": ids[out], "links": links[out].astype(np.int64), "other": ids[group[out]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row (id, n_links, component_id, kept) per row of ``vectors``.

    Equal vectors are one class, compared once and counted as often as they stand there. Each of ``trees`` trees splits
    space at random, vectors near a split go both ways, and vectors of a leaf are compared in double precision; a
    pair is counted in the first leaf it shares. Leaves above 1024 vectors are compared block by block. A block returns a count and one
    link for each of its vectors, not its pairs. NULL, zero or empty vectors and those with NULL or non-finite parts link with
    nothing, vectors of other length only with their own. Ids are whole numbers; rows under one id are one vector, NULL ids have no
    component of their own. The sample for the splits is bounded (16,384 vectors); every vector is indexed. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    sound = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = cut(rows.where("sound").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    forests: dict[int, list[Tree]] = {}
    for r in classes.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("total")).collect():
        own = classes.where(F.size("vec") == r.length).orderBy(F.xxhash64("vec")).limit(SAMPLE)
        sample = _unit([x.vec for x in own.select("vec").collect()])
        forests[r.length] = [grow(sample, r.total, t, cosine=cosine) for t in range(trees)]
    sent = spark.sparkContext.broadcast(forests)
    kind = vectors.schema[vec_col].dataType

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vec"].map(len)):
                unit = _unit(part["vec"])
                for t, tree in enumerate(sent.value[unit.shape[1]]):
                    at, leaf = tree.route(unit)
                    yield pd.DataFrame({"tree": t, "leaf": leaf, "id": part["id"].to_numpy()[at], "n": part["n"].to_numpy()[at], "vec": part["vec"].to_numpy()[at]})

    shape = T.StructType([
        T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("vec", kind),
    ])
    routed = classes.where("id IS NOT NULL").mapInPandas(route, shape).withColumn("length", F.size("vec"))
    place = ["tree", "leaf", "length"]
    large = routed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = routed.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    dealt = dealt.select("*", other).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    found = cut(
        dealt.select(*place, "i", "j", "id", "n", "vec", "block").groupBy(*place, "i", "j")
        .applyInPandas(lambda part: _compare(sent.value, part, cosine), "id long, links long, other long")
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found, "id", "other").withColumnRenamed("node", "id")
    named = classes.join(counts, "id", "left").join(labels, "id", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    linked = rows.where("sound").join(named, "vec").select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
