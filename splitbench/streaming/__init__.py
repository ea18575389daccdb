"""Incremental ingest of new references."""
