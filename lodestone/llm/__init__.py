"""Operators for training-data pipelines: scoring, de-duplication, mixing, packing and search.

Nothing else in the library imports this subpackage.
"""
