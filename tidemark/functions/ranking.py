"""Top-n, paging and shares of a total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _named(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str | None = None, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of every group in a total order.

    A group is first cut to ``n`` rows per salt, then ranked, so a hot group is never sorted whole in one task,
    whatever ``n``. The result does not depend on salts.
    """
    keys, order = list(keys), _named(order)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    df = (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
        .filter(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0, probe: bool = True) -> DataFrame:
    """One page in order; ``probe`` asks for one row more, which tells whether a next page exists."""
    return df.orderBy(*_named(order)).offset(offset).limit(limit + 1 if probe else limit)


def after_key(order: Sequence[tuple[str, bool]], key: Sequence[object]) -> Column:
    """Rows that come after ``key`` in a lexicographic order; ``(column, True)`` is descending."""
    found = F.lit(False)
    for i, (name, descending) in enumerate(order):
        step = F.col(name) < F.lit(key[i]) if descending else F.col(name) > F.lit(key[i])
        for (same, _), value in zip(order[:i], key[:i], strict=True):
            step = (F.col(same) == F.lit(value)) & step
        found = found | step
    return found


def keyset_page(
    df: DataFrame, order: Sequence[tuple[str, bool]], size: int, after: Sequence[object] | None = None
) -> DataFrame:
    """The ``size`` rows after a key. The first column also gets a plain bound, which scans can push down."""
    if after is not None:
        name, descending = order[0]
        bound = F.col(name) <= F.lit(after[0]) if descending else F.col(name) >= F.lit(after[0])
        df = df.filter(bound & after_key(order, after))
    return df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order]).limit(size)


def with_totals(df: DataFrame, names: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add totals of columns (``{column: name}``), per ``by`` or over all rows, to an aggregated frame.

    The totals are one small aggregate, joined back or read by a scalar subquery. A window would pull all
    rows of a key, or the whole frame, into one task.
    """
    sums = {name: F.sum(col) for col, name in names.items()}
    if not by:
        return with_overall(df, df, sums)
    return df.join(df.groupBy(*by).agg(*[col.alias(name) for name, col in sums.items()]), list(by))


def with_total(df: DataFrame, col: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the total of one column."""
    return with_totals(df, {col: name}, by)


def with_overall(df: DataFrame, rows: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Add aggregates over ``rows`` to every row of ``df``, by one scalar subquery."""
    packed = rows.agg(F.struct(*[col.alias(name) for name, col in aggs.items()]).alias("_overall")).scalar()
    wide = df.withColumn("_overall", packed)
    return wide.select(*df.columns, *[F.col("_overall")[name].alias(name) for name in aggs])


def share(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """Percentage of a whole, 0 when the whole is empty."""
    part, whole = _named([part, whole])
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


def literal_frame(spark: SparkSession, rows: Sequence[Sequence[object]], names: Sequence[str]) -> DataFrame:
    """A small frame of given values whose size Spark knows, so that it may choose to broadcast it."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
