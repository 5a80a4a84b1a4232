"""Operators of a training-data pipeline: dedup, formatting, archives, scoring, search, mixing."""
