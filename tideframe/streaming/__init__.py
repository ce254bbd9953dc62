"""Incremental builds over streams."""
