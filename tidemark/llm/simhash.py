"""SimHash near duplicates: generalised pigeonhole over groups of correlated bits with unequal thresholds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, in_batches, release
from tidemark.llm.components import components

SHINGLE = 3
DISTANCE = 3
SAMPLE = 2048  # distinct fingerprints that the driver sees to plan the probes
JOINED = 128  # fingerprints of a bucket that a plain join may pair
BLOCK = 512  # fingerprints on either side of a comparison in one block
BITS = 64
PROBES = 1024  # flips a part may probe for; they stand as literals in the plan
_LOWER = bytes(c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, as a signed number.

    Words are what ASCII white space parts, A-Z lower-cased; each run of ``shingle`` words (all words, if fewer) votes with
    its XXH64 of seed 42, repeats included, and a bit is set by more than half the votes. A text without words has fingerprint 0.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    stops = (ends[width - 1:] - 1).tolist()
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts[k:k + _CHUNK], stops[k:k + _CHUNK], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """Add the fingerprint of each whole text; a column of that name is replaced."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
            release()

    return in_batches(docs).withColumn(out, fp(F.col(text_col)))


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int  # differing bits to probe for; -1 leaves the part out

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def probes(self) -> list[int]:
        return [sum(1 << b for b in c) for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_bits(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Split the columns of a 0/1 sample into parts of near-equal width, strongly correlated columns together."""
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1.0
    related = np.abs((centred / spread).T @ (centred / spread))
    np.fill_diagonal(related, 0.0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        inner = related[np.ix_(left, left)]
        group = [left[int(np.argmax(inner.max(axis=1)))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(related[np.ix_(group, rest)].sum(axis=0)))])
        left = [b for b in left if b not in group]
        out.append(tuple(sorted(group)))
    return out


def _chances(bits: np.ndarray, group: tuple[int, ...], most: int) -> list[float]:
    """For each number of bits up to ``most``, the chance that two fingerprints differ in no more of the group's bits.

    The greater of what the sample's pairs show and what independent bits would give: a sample alone cannot see rare chances.
    """
    column = bits[:, list(group)]
    agree = column @ column.T + (1.0 - column) @ (1.0 - column).T
    apart = (len(group) - agree)[np.triu_indices(len(bits), 1)]
    ones = column.mean(axis=0)
    exact = np.zeros(len(group) + 1)
    exact[0] = 1.0
    for p in 2 * ones * (1 - ones):
        exact[1:] = exact[1:] * (1 - p) + exact[:-1] * p
        exact[0] *= 1 - p
    return [max(float((apart <= t + 0.5).mean()) if len(apart) else 0.0, float(exact[: t + 1].sum())) for t in range(most + 1)]


def plan_parts(sample: list[int], total: int, distance: int = DISTANCE) -> list[Part]:
    """Parts and thresholds with the least estimated cost.

    For m parts, thresholds that sum to distance - m + 1 find every pair: more differing bits in each part than its
    threshold would add up to more than the distance. Dynamic programming over the parts allots the thresholds; a part
    costs the rows it sends and the candidate pairs estimated from the sample. The plan changes cost only, never results.
    A part that would need more than PROBES flips of one size is left out; distance + 1 parts of threshold 0 always remain.
    """
    total = max(total, 1)
    if len(sample) < 2:
        sample = [*sample, 0, -1]
    unsigned = np.array(sample, np.int64).view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(unsigned, axis=1, bitorder="little").astype(float)
    best: tuple[float, list[Part]] | None = None
    for m in range(1, distance + 2):
        budget = distance - m + 1
        groups = group_bits(bits, m)
        most = distance
        costs: list[dict[int, float]] = []
        for group in groups:
            chance = _chances(bits, group, most)
            part = {-1: 0.0}
            sent = 0.0
            for t in range(most + 1):
                sent += float(np.prod([(len(group) - i) / (i + 1) for i in range(t)])) * (0.5 if t else 1.0)
                if math.comb(len(group), t) > PROBES:
                    break
                part[t] = total * (1.0 + sent) + 0.5 * total * total * chance[t]
            costs.append(part)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in reach.items():
                for t, more in part.items():
                    if spent + t not in after or cost + more < after[spent + t][0]:
                        after[spent + t] = (cost + more, [*chosen, t])
            reach = after
        if budget in reach and (best is None or reach[budget][0] < best[0]):
            best = (reach[budget][0], [Part(g, t) for g, t in zip(groups, reach[budget][1], strict=True)])
    return [p for p in best[1] if p.threshold >= 0]


def _block_links(distance: int):
    """Links within one block: a tree over the fingerprints that lie within the distance, not all pairs."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(rows.loc[~rows["probe"], "fp"].to_numpy(np.int64))
        right = np.unique(rows.loc[rows["probe"], "fp"].to_numpy(np.int64))
        near = np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= distance
        of_right = np.arange(len(left), len(left) + len(right))
        of_left = np.arange(len(left))
        while True:  # least label over neighbours until nothing changes
            to_left = np.minimum(of_left, np.where(near, of_right[None, :], len(left) + len(right)).min(axis=1, initial=len(left) + len(right)))
            to_right = np.minimum(of_right, np.where(near, to_left[:, None], len(left) + len(right)).min(axis=0, initial=len(left) + len(right)))
            if np.array_equal(to_left, of_left) and np.array_equal(to_right, of_right):
                break
            of_left, of_right = to_left, to_right
        every = np.concatenate([left, right])
        return pd.DataFrame({"a": every, "b": every[np.concatenate([of_left, of_right])]}).query("a != b")

    return links


def link(fingerprints: DataFrame, fp: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) among distinct fingerprints that connect exactly those within ``distance`` of each other, directly or by steps.

    Buckets of up to 128 fingerprints are paired by a join; a fuller one is cut into blocks of 512 by hash, every pair
    of blocks is compared somewhere, and a block sends a tree of its links. NULL fingerprints link with nothing.
    """
    nodes = cut(fingerprints.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct())
    total = nodes.count()
    if total < 2:
        return nodes.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    sample = [r.fp for r in nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    parts = plan_parts(sample, total, distance)
    plan = F.array(*[
        F.struct(F.lit(i).alias("part"), F.lit(_signed(p.mask)).alias("mask"), F.array(*[F.struct(F.lit(_signed(x)).alias("flip"), F.lit(_signed(x & -x)).alias("lowest")) for x in p.probes()]).alias("flips"))
        for i, p in enumerate(parts)
    ])
    spread = nodes.select("fp", F.inline(plan))
    index = spread.select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    flipped = spread.select("part", "mask", "fp", F.inline("flips"))
    # Of two fingerprints that differ by a flip, the one with a 0 at its lowest bit sends the probe.
    probe = flipped.where((F.col("flip") == 0) | (F.col("fp").bitwiseAND(F.col("lowest")) == 0)).select(
        "part", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") == 0).alias("same"),
    )
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"))
    sized = index.join(sizes, ["part", "key"])
    # What both ways read is kept once: the index beside the size of its bucket, a row a fingerprint and part.
    sized = cut(sized)
    small = sized.where(F.col("size") <= JOINED).drop("size")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (
        small.withColumnRenamed("fp", "a").join(probe.withColumnRenamed("fp", "b"), ["part", "key"])
        .where((~F.col("same") | (F.col("a") < F.col("b"))) & (apart <= distance)).select("a", "b")
    )
    large = sized.where(F.col("size") > JOINED)
    hot = large.select("part", "key", "size").distinct()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = probe.join(hot, ["part", "key"])
    met_blocks = met.groupBy("part", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("columns"))
    block_of = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.join(met_blocks, ["part", "key"]).select(
        "part", "key", "fp", blocks.alias("rows"), F.pmod(F.xxhash64("fp"), F.col("columns")).cast("int").alias("column"),
    )
    sides = (
        large.join(met_blocks, ["part", "key"]).select("part", "key", "fp", blocks.alias("blocks"), "columns")
        .select("part", "key", "fp", F.lit(False).alias("probe"), block_of.alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    ).unionByName(met.select("part", "key", "fp", F.lit(True).alias("probe"), "column", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")))
    trees = sides.groupBy("part", "key", "row", "column").applyInPandas(_block_links(distance), "a long, b long")
    return pairs.unionByName(trees)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row (id, mark, fp, group, component_id) per row of ``docs``.

    Fingerprints within ``distance`` bits link; component_id is the least id reachable by links, the row's own included, and ``group`` the
    least fingerprint. ``mark`` is a hash of id and text. Equal fingerprints are one node however many rows share them. A NULL or
    wordless text has fingerprint 0 and links like any other; a NULL id is the least only of a group without another. An empty frame
    gives an empty frame. Other columns are left out.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"))
    rows = cut(with_fingerprint(given, "text", shingle).select("id", "mark", "fp"))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    labels = components(link(rows, "fp", distance), "a", "b")
    placed = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("group"))
    named = placed.groupBy("group").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.join(named, "group").select("fp", "group", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "mark", "fp", "group", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: among rows under the group's least id one text, by its mark, and of equal ones the least by a hash of its columns as JSON.

    All columns stay, whatever their types. Only rows that stand more than once are gathered to choose among them; a group of them is one minimum.
    """
    first = (
        groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("group", F.col(id_col).alias("id"), "mark").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("group").agg(F.min(F.struct("id", "mark", "rows")).alias("first"))
        .select(F.col("first.id").alias("__id"), F.col("first.mark").alias("__mark"), F.col("first.rows").alias("__rows"))
    )
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("__mark"))
    single = docs.join(first.where("__rows = 1"), same, "left_semi")
    several = docs.join(first.where("__rows > 1"), same)
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    one = several.groupBy("__id", "__mark").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
    return single.unionByName(one.select(*[F.col(f"__row.`{c}`") for c in columns]))
