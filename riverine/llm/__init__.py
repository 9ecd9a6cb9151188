"""Operators of a training-data pipeline: deduplication, filtering, tokenising, packing, archives."""
