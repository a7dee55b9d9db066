"""Structured Streaming forms of ingest, sessions and rollups."""
