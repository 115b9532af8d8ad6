"""Composed jobs: medallion models, ingest runs, metric contracts."""
