"""Operators for training data: filters, near duplicates, encodings, searches and mixing.

Nothing else in the package imports this folder.
"""
