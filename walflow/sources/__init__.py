"""Logs: one derived from order tables, and write-ahead logs in files."""
