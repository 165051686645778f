"""Daily-partitioned tables: range scans, idempotent writes, compaction and retention."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("log_date", "package_nm", "server_type")


def scan_range(
    spark: SparkSession, path: str, schema: T.StructType, start: dt.date, end: dt.date, fmt: str = "parquet"
) -> DataFrame:
    """Rows of the daily partitions from ``start`` to ``end``, both kept; other folders are not read."""
    return spark.read.schema(schema).format(fmt).load(path).filter(F.col("log_date").between(F.lit(start), F.lit(end)))


def scan_moments(
    spark: SparkSession, path: str, schema: T.StructType, start: dt.datetime, end: dt.datetime, ts: str
) -> DataFrame:
    """A timestamp range with the day filter beside it, so partitions are pruned as well."""
    days = scan_range(spark, path, schema, start.date(), end.date())
    return days.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def with_doc_id(df: DataFrame, keys: Sequence[str], name: str = "doc_id") -> DataFrame:
    """A row id from the natural key, the same on every replay."""
    return df.withColumn(name, F.concat_ws("_", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def one_per_doc(df: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """One row per document id, the newest version first, then by content; reduced before the shuffle."""
    values = [c for c in df.columns if c not in keys]
    rank = F.struct(*([F.col(version)] if version else []), F.xxhash64(*[F.col(c) for c in df.columns]))
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _balanced(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Gather the rows of a partition folder into few files, but split a folder with very many rows."""
    return df.hint("rebalance", *partitions) if partitions else df


def write_batch(
    df: DataFrame, path: str, batch_id: int, partitions: Sequence[str] = PARTITIONS, doc_id: Sequence[str] | None = None,
    version: str | None = None,
) -> None:
    """Write one micro-batch under its own id. Writing the same batch again replaces it.

    Old data is never read, so the cost follows the batch, not the table. Copies in different batches
    are settled when the table is read or compacted.
    """
    rows = df if doc_id is None else one_per_doc(with_doc_id(df, doc_id), ["doc_id"], version)
    (
        _balanced(rows, partitions).withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *partitions)
        .parquet(path)
    )


def _batches(spark: SparkSession, path: str, schema: T.StructType, days: Sequence[dt.date] | None) -> DataFrame:
    """Rows of a batch-written table with their batch; only the folders of ``days`` are read when given."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    return rows if days is None else rows.filter(F.col("log_date").isin(*days))


def read_latest(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: str | None = None, days: Sequence[dt.date] | None = None
) -> DataFrame:
    """A batch-written table with one row per key; among equal versions the later batch wins."""
    return _newest(_batches(spark, path, schema, days), schema, keys, version)


def _newest(rows: DataFrame, schema: T.StructType, keys: Sequence[str], version: str | None) -> DataFrame:
    rank = F.struct(*([F.col(version)] if version else []), F.col("batch_id"))
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in keys]), rank).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in schema.names])


def compact(
    spark: SparkSession, path: str, target: str, schema: T.StructType, keys: Sequence[str], day: dt.date, version: str | None = None
) -> None:
    """Settle one day of a batch-written table into a table without batch folders, and then remove the day's batch folders.

    Only the day's folders are read. Rows settled before take part, older than any batch, so rows that come late and a second
    run are fine. The new day folder is written aside and takes the old one's place by renaming; the old one and the batch folders go only after that.
    A run that fails on the way leaves them, and the next one puts an old day folder back that has none in its place.
    """
    _restore(spark, target, day)
    settled = [f for f in _day_folders(spark, path) if f.day == day.isoformat()]
    if not settled:
        return
    rows = _batches(spark, path, schema, [day])
    if exists(spark, f"{target}/log_date={day}"):
        before = spark.read.schema(schema).parquet(target).filter(F.col("log_date") == F.lit(day))
        rows = rows.unionByName(before.withColumn("batch_id", F.lit(-1).cast("long")))
    staged = f"{target}/_staged/{uuid.uuid4().hex}"
    write_partitioned(_newest(rows, schema, keys, version), staged)
    _switch(spark, staged, target, day)
    _remove(spark, path, settled)


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS, mode: str = "append") -> None:
    """Append by day, package and server, or replace only the partitions the rows touch."""
    _balanced(df, partitions).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_with_dead_letter(
    df: DataFrame, sink: Callable[[DataFrame], None], dead_letter: str, batch_id: int | None = None
) -> bool:
    """Run a write; when it fails keep its rows with the error text. True when the write went through."""
    try:
        sink(df)
        return True
    except Exception as error:  # noqa: BLE001 - any failed write is kept
        kept = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("row"))
        target = dead_letter if batch_id is None else f"{dead_letter}/batch_id={batch_id}"
        (
            kept.withColumn("error", F.lit(str(error)))
            .withColumn("failed_at", F.current_timestamp())
            .write.mode("append" if batch_id is None else "overwrite")
            .parquet(target)
        )
        return False


def apply_retention(df: DataFrame, ts: str, days: int, as_of: dt.date) -> DataFrame:
    """Rows of the last ``days`` days, for date and timestamp columns alike."""
    return df.filter(F.col(ts) >= F.lit(as_of - dt.timedelta(days=days)))


@dataclass(frozen=True)
class DayFolder:
    """A day's folder of a table, at its root or below a batch folder."""

    path: str
    day: str


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _switch(spark: SparkSession, staged: str, target: str, day: dt.date) -> None:
    """Put a day folder in the place of the old one, which is kept aside until the new one is there."""
    name, aside = f"log_date={day}", f"{target}/_replaced"
    system, new = _files(spark, f"{staged}/{name}")
    _, place = _files(spark, f"{target}/{name}")
    _, old = _files(spark, f"{aside}/{name}")
    if system.exists(place):
        system.mkdirs(old.getParent())
        if not system.rename(place, old):
            raise OSError(f"{place} cannot be renamed")
    if not system.rename(new, place):
        raise OSError(f"{new} cannot be renamed")
    for done in (old, new.getParent()):
        system.delete(done, True)


def _restore(spark: SparkSession, target: str, day: dt.date) -> None:
    """Undo or end a switch that stopped half way."""
    system, place = _files(spark, f"{target}/log_date={day}")
    _, old = _files(spark, f"{target}/_replaced/log_date={day}")
    if system.exists(old):
        if system.exists(place):
            system.delete(old, True)
        elif not system.rename(old, place):
            raise OSError(f"{old} cannot be renamed")


def exists(spark: SparkSession, path: str) -> bool:
    system, root = _files(spark, path)
    return system.exists(root)


def _day_folders(spark: SparkSession, path: str) -> list[DayFolder]:
    """Day folders of a table, whether written by day or by batch and day. Only names are listed."""
    system, root = _files(spark, path)
    found = []
    for status in system.listStatus(root) if system.exists(root) else ():
        name = status.getPath().getName()
        inner = system.listStatus(status.getPath()) if name.startswith("batch_id=") else [status]
        for folder in inner:
            key, _, day = folder.getPath().getName().partition("=")
            if folder.isDirectory() and key == "log_date":
                found.append(DayFolder(folder.getPath().toString(), day))
    return found


def _remove(spark: SparkSession, path: str, folders: Sequence[DayFolder]) -> None:
    """Delete day folders, and batch folders that hold no other."""
    system, _ = _files(spark, path)
    for folder in folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.path)
        system.delete(at, True)
        batch = at.getParent()
        if batch.getName().startswith("batch_id=") and not any(x.isDirectory() for x in system.listStatus(batch)):
            system.delete(batch, True)


def remove_below(spark: SparkSession, path: str, key: str, limit: int) -> None:
    """Delete the ``key=number`` folders of a table whose number is less than ``limit``."""
    system, root = _files(spark, path)
    for status in system.listStatus(root) if system.exists(root) else ():
        name, _, number = status.getPath().getName().partition("=")
        if name == key and int(number) < limit:
            system.delete(status.getPath(), True)


def remove_batches(spark: SparkSession, path: str, upto: int) -> None:
    """Delete the folders of batches up to ``upto``."""
    remove_below(spark, path, "batch_id", upto + 1)


def drop_expired_partitions(spark: SparkSession, path: str, days: int, as_of: dt.date) -> list[str]:
    """Delete ``log_date=`` folders older than the retention, without reading them; those below batch folders too.

    Listing and deleting go through the cluster's file system, which Spark Connect sessions do not offer.
    """
    limit = (as_of - dt.timedelta(days=days)).isoformat()
    gone = [f for f in _day_folders(spark, path) if f.day < limit]
    _remove(spark, path, gone)
    return sorted({f"log_date={f.day}" for f in gone})
