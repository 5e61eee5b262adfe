"""Streams: stateful transaction assembly and idempotent ingestion."""
