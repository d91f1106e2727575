"""Incremental ingest and windowed counts (extensions)."""
