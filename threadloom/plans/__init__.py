"""Whole runs: configuration, inventory, staging, index, reports and verification."""
