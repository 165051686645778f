"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots in each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 128


def _costs(keys: Sequence[Column], weights: Sequence[float], first: int = 0) -> list[Column]:
    """What each shard bids for a key: -ln(u) / weight with u uniform in (0, 1) by key and shard; the least bid wins."""
    bids = []
    for shard, weight in enumerate(weights, first):
        if not weight > 0:
            raise ValueError("shard weights must be positive")
        u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        bids.append(-F.ln(u) / F.lit(float(weight)))
    return bids


def shard_of(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """Shard number of a key. Keys, shard number and weights decide alone; a NULL key is a key like any other.

    A shard's share of the keys is its share of the weights. Adding shards at the end, or raising a weight, moves
    keys only into the shards added or raised.
    """
    if not weights:
        raise ValueError("at least one shard is needed")
    bids = F.array(*_costs(keys, weights))
    return (F.array_position(bids, F.array_min(bids)) - 1).cast("int")


def grown_shard_of(keys: Sequence[Column], weights: Sequence[float], added: float = 1.0) -> Column:
    """Shard number once a shard of weight ``added`` stands behind the others."""
    return shard_of(keys, [*weights, added])


def with_slots(df: DataFrame, shard: str, order: Sequence[str], slices: int = SLICES, slot: str = "slot") -> DataFrame:
    """Add a gapless position from 0 in each shard to rows of small columns.

    Equal rows are counted before anything moves and unfolded at the end, so copies of one key cost one row. A shard
    is cut into ``slices`` by a hash of the whole row; each slice is numbered alone and shifted by the rows of the
    slices before it. No task holds a shard. An empty frame gives an empty frame; an existing slot column is replaced.
    """
    rows = df.drop(slot)
    names = rows.columns
    counted = (
        rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("__copies"))
        .withColumn("__slice", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(slices)).cast("int"))
    )
    by_slice = Window.partitionBy(shard, "__slice").orderBy(*order, *[F.col(f"`{c}`") for c in names if c not in order])
    placed = counted.withColumn("__end", F.sum("__copies").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("__to").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counted.groupBy(F.col(shard).alias("__to"), F.col("__slice").alias("__part")).agg(F.sum("__copies").alias("__size"))
        .withColumn("__shift", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    )
    match = (F.col(shard).eqNullSafe(F.col("__to"))) & (F.col("__slice") == F.col("__part"))
    start = F.col("__shift") + F.col("__end") - F.col("__copies")
    return placed.join(shifts, match).select(
        *[F.col(f"`{c}`") for c in names],
        F.explode(F.sequence(start, start + F.col("__copies") - 1)).alias(slot),
    )
