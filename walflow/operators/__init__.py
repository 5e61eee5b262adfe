"""Batch operators over change logs."""
