"""Keeps the registered queries, and the check SQL of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import logtypes as lt
from tidemark.functions.ranking import literal_frame
from tidemark.operators import ingest, kpi, rollup
from tidemark.sources import driver_tables as dtb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# The driver's events have no app-start rows; page starts stand for visits in the access tables.
VISITS = (lt.APP_FIRST_START, lt.WEB_START)


@dataclass(frozen=True)
class Tables:
    """The canonical frames over one data folder."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return dtb.table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        frames = {
            "events": dtb.event_log, "pages": dtb.page_flow, "trouble": dtb.trouble_log, "network": dtb.network_log,
            "vitals": dtb.vital_log, "marketing": dtb.mkt_event, "devices": dtb.device_info,
            "visits": dtb.daily_access, "perf": dtb.perf_entries,
        }
        if name in frames:
            return frames[name](self.spark, self.sf_dir)
        if name == "access":
            return rollup.access_history(self.events, VISITS)
        if name == "page_daily":
            return rollup.page_daily(self.pages)
        if name == "model_hourly":
            return rollup.model_hourly(self.pages)
        if name == "statistic":
            return kpi.statistic_history(self.access, self.pages, dtb.FIRST_DAY, dtb.AS_OF)
        if name == "engines":
            return literal_frame(self.spark, list(ingest.SEARCH_ENGINES.items()), ["domain", "engine_name"])
        raise AttributeError(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes, in the shared folder the cluster names, else in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def portable(df: DataFrame) -> DataFrame:
    """Plain column types, so that results compare across engines: whole numbers long, times as text."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|", "")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, check: str | None = None, ctes: str = ""):
    """Register a query; ``check`` is SELECT text over the canonical frames, ``ctes`` more of them."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The check SQL reads times as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return portable(build(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if check is not None:
            more = f",\n{ctes.strip()}" if ctes else ""
            CHECKS[name] = f"WITH {dtb.CHECK_CTES.strip()}{more}\n{check.strip()}"
        return build

    return add
