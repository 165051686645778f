"""Structured Streaming forms of the ingest and snapshot operators."""
