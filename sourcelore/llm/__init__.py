"""Operators of a training-data pipeline: deduplication, search, scans, sharding, mixing, tokens."""
