"""Incremental scene ingest."""
