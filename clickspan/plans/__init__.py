"""Composite plans: rollup tables, the ingest chain and the query catalogue."""
