"""Operators for training-data pipelines: deduplication, packing, mixing, search, scoring, formatting."""
