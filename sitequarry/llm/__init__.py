"""Operators of a training-data pipeline: counting, cleaning, deduplication and packing of documents."""
