"""Preparing training data: extraction, filters, duplicates, mixing, packing and vector search.

Nothing else in the library imports this package.
"""
