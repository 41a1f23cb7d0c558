"""Readers, writers and the deterministic lead view."""
