"""Operators of a training-data pipeline: filtering, deduplication, scanning, packing, sharding and token output."""
