"""Operators of a training-data pipeline: filtering, near copies, sharding, packing, search."""
