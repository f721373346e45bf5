"""Operators of a training-data pipeline: tokens, deduplication, scans, quality.

Nothing else in the library imports this subpackage.
"""
