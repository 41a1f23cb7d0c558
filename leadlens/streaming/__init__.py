"""Structured Streaming entry points (same scoring functions as batch)."""
