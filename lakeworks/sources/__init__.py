"""Readers, Parquet tables and load state."""
