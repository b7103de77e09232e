"""Operators of a training-data pipeline: counting, labelling, filtering, deduplication, mixing, packing."""
