"""Operators of a training-data pipeline: near duplicates, sharding, token files, mixing, packing, scans and scores."""
