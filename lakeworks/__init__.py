"""Lakehouse team toolkit: ingest, change data, models, analytics and checks as PySpark DataFrame operators."""

__version__ = "0.1.0"
