"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: what the cluster names in ``spark.checkpoint.dir``, or one in the warehouse where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that lost executors do not redo what led to it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


BATCH_ROWS = 2500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(docs: DataFrame) -> DataFrame:
    """The frame, in a session that hands whole texts to Python 2,500 rows at a time, unless it names a bound of its own.

    Spark's own bound of 10,000 rows counts rows of a few numbers; texts of a few KB fill tens of MB on either side with it.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def release() -> None:
    """Give memory that a worker is done with back to the machine; called between batches."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_STATE: dict[object, object] = {}


def worker_state(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that stages do not pile up their models in it."""
    if key not in _STATE:
        _STATE.clear()
        release()
        _STATE[key] = build()
    return _STATE[key]


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text has remainder 2 by 4. A NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
