"""Column expressions (native Catalyst expressions only; no Python UDFs)."""
