"""Structured Streaming forms of landing, metrics, duplicates and health."""
