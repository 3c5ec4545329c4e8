"""Operators of a training-data pipeline: deduplication, filtering, scanning, mixing, sharding."""
