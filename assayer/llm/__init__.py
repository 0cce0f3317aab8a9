"""Operators of a training-data pipeline: filtering, deduplication, scans, scoring and packing."""
