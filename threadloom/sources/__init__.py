"""Readers: Parquet tables, ZIP archives and strict JSON arrays."""
