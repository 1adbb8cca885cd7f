"""Operators of a training-data pipeline: dedup, scoring, formatting, packing, archives."""
