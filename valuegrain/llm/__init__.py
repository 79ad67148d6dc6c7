"""Operators of a training-data pipeline: sharding, filtering, deduplication, mixing, packing, search."""
