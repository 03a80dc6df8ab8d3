"""Structured Streaming forms of ingest and rollups."""
