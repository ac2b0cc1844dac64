"""Operators of a training-data pipeline: tokenising, filtering, near-duplicate search, packing and record output.

Nothing else in the library imports this subpackage.
"""
