"""Registered queries over the driver tables, each with its check SQL."""

from tidemark.plans import ingest_queries, kpi_queries, rollup_queries, session_queries, widget_queries, perf_queries, version_queries, waterfall_queries, funnel_queries, sketch_queries, stream_queries  # noqa: F401
from tidemark.plans.registry import CHECKS, QUERIES  # noqa: F401
