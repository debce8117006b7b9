"""Operators of a training-data pipeline: quality rules, packing, deduplication, scoring, search and mixing.

Nothing else in the library imports this subpackage.
"""
