"""Shards that keep arriving."""
