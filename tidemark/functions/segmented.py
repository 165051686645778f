"""Running values over ordered groups that may be very large.

A plain window per device puts one device in one task. Here a group is cut into segments (a time
slice, or a slice of values). Rows are shuffled by (group, segment), the running value is taken inside
the segment, and one summary row per segment carries the earlier segments' value in. A group with a
third of all rows is then spread over as many tasks as it has segments, and only the summary rows,
one per segment, are ever ordered per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"
SLICES = 64  # value slices of a group with very many distinct values
SLICED = 4096  # distinct values that need no slices
SALTS = 16


class SegmentedScan:
    """Collects running columns over ``keys`` ordered by ``order`` and adds them in one pass."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column | None = None):
        """Without ``segment`` the segments of an earlier scan are kept, and with them its partitioning."""
        self.keys = list(keys)
        self.order = list(order)
        self.df = df if segment is None else df.withColumn(SEGMENT, segment.cast("long"))
        self._values: dict[str, Column] = {}
        self._local: dict[str, Column] = {}
        self._summary: dict[str, Column] = {}
        self._carry: dict[str, Column] = {}
        self._final: dict[str, Column] = {}
        part = [*self.keys, SEGMENT]
        ordered = Window.partitionBy(*part).orderBy(*self.order)
        self._here = ordered.rowsBetween(Window.unboundedPreceding, 0)
        self._one = ordered
        earlier = Window.partitionBy(*self.keys).orderBy(SEGMENT)
        self._before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        self._after = earlier.rowsBetween(1, Window.unboundedFollowing)
        self._whole = Window.partitionBy(*self.keys)

    def _sort_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def lag(self, name: str, col: str) -> SegmentedScan:
        """Value of ``col`` on the previous row of the group (NULL on the first row)."""
        self._local[f"_l_{name}"] = F.lag(F.struct(F.col(col).alias("v"))).over(self._one)
        self._summary[f"_s_{name}"] = F.max_by(F.struct(F.col(col).alias("v")), self._sort_key())
        self._carry[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(self._before)
        self._final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))["v"]
        return self

    def lead(self, name: str, col: str) -> SegmentedScan:
        """Value of ``col`` on the next row of the group (NULL on the last row)."""
        self._local[f"_l_{name}"] = F.lead(F.struct(F.col(col).alias("v"))).over(self._one)
        self._summary[f"_s_{name}"] = F.min_by(F.struct(F.col(col).alias("v")), self._sort_key())
        self._carry[f"_c_{name}"] = F.first(f"_s_{name}", ignorenulls=True).over(self._after)
        self._final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))["v"]
        return self

    def running_sum(self, name: str, col: Column) -> SegmentedScan:
        """Sum from the first row of the group up to and including this one."""
        self._values[f"_v_{name}"] = col
        self._local[f"_l_{name}"] = F.sum(f"_v_{name}").over(self._here)
        self._summary[f"_s_{name}"] = F.sum(f"_v_{name}")
        self._carry[f"_c_{name}"] = F.sum(f"_s_{name}").over(self._before)
        self._final[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        return self

    def running_last(self, name: str, col: Column) -> SegmentedScan:
        """Latest non-NULL value of ``col`` up to and including this row."""
        self._values[f"_v_{name}"] = col
        self._local[f"_l_{name}"] = F.last(f"_v_{name}", ignorenulls=True).over(self._here)
        self._summary[f"_s_{name}"] = F.max_by(
            F.col(f"_v_{name}"), F.when(F.col(f"_v_{name}").isNotNull(), self._sort_key())
        )
        self._carry[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(self._before)
        self._final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
        return self

    def total(self, name: str, col: Column) -> SegmentedScan:
        """Sum over the whole group, on every row."""
        self._values[f"_v_{name}"] = col
        self._summary[f"_s_{name}"] = F.sum(f"_v_{name}")
        self._carry[f"_c_{name}"] = F.sum(f"_s_{name}").over(self._whole)
        self._final[name] = F.col(f"_c_{name}")
        return self

    def lowest(self, name: str, col: str) -> SegmentedScan:
        """Smallest value in the whole group, on every row."""
        self._summary[f"_s_{name}"] = F.min(col)
        self._carry[f"_c_{name}"] = F.min(f"_s_{name}").over(self._whole)
        self._final[name] = F.col(f"_c_{name}")
        return self

    def done(self, keep_segment: bool = False) -> DataFrame:
        part = [*self.keys, SEGMENT]
        plain = [c for c in self.df.columns if keep_segment or c != SEGMENT]
        valued = self.df.withColumns(self._values) if self._values else self.df
        local = valued.select(*self.df.columns, *[col.alias(name) for name, col in self._local.items()])
        summary = valued.groupBy(*part).agg(*[col.alias(name) for name, col in self._summary.items()])
        carry = summary.select(*part, *[col.alias(name) for name, col in self._carry.items()])
        return local.join(carry, part).select(*plain, *[col.alias(name) for name, col in self._final.items()])


def value_slices(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``_segment``: the slice of a value among those of its group, in order, with about equally many distinct values each.

    Bounds come from a mergeable summary of each group's own values, so they fit any scale and any distribution. They meet the rows by (group,
    salt), so no task holds a group.
    """
    keys = list(keys)
    points = [i / SLICES for i in range(1, SLICES)]
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(value, points, 10 * SLICES).alias("_bounds"), F.count(F.lit(1)).alias("_values"))
    bounds = bounds.filter(F.col("_values") > SLICED).select(*keys, F.array_distinct("_bounds").alias("_bounds"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    at = F.size(F.filter(F.col("_bounds"), lambda b: b <= F.col(value)))
    return salted.join(bounds, [*keys, "_salt"], "left").withColumn(SEGMENT, F.coalesce(F.when(F.col("_bounds").isNotNull(), at), F.lit(0)).cast("long")).drop("_salt", "_bounds")


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact interpolated percentiles of ``value`` per group, plus the row count ``n``.

    ``weight`` names a count column when rows already stand for several equal values. Equal values are counted first, so what is ordered is one row per distinct value, cut into value
    slices by the group's own values. A task holds one slice of a group.
    """
    by = list(by)
    keyed = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    counts = (
        source.filter(F.col(value).isNotNull())
        .groupBy(*keyed, F.col(value).alias("_value"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_cnt"))
    )
    # Group columns may be NULL; join on a text key that is not.
    nullable = {k: F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keyed}
    counts = counts.select(
        *[c.alias(f"_k{i}") for i, c in enumerate(nullable.values())], *keyed, "_value", "_cnt"
    )
    hashed = [f"_k{i}" for i in range(len(keyed))]
    ranked = (
        SegmentedScan(value_slices(counts, hashed, "_value"), hashed, ["_value"])
        .running_sum("_upto", F.col("_cnt"))
        .total("_n", F.col("_cnt"))
        .done()
    )

    def at(rank: Column) -> Column:
        hit = (F.col("_upto") - F.col("_cnt") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(hit, F.col("_value").cast("double")))

    picks = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        picks += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    found = ranked.groupBy(*keyed).agg(F.max("_n").alias("n"), *picks)
    frac = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in points.items()}
    return found.select(
        *by,
        "n",
        *[
            (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * (pos - F.floor(pos))).alias(m)
            for m, pos in frac.items()
        ],
    )


def medians(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per group; same as ``median`` but without one task per group."""
    return percentiles(df, by, value, {name: 0.5}).drop("n")
