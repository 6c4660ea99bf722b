"""Operators for large text corpora used as training data.

Nothing else in the package imports this subpackage.
"""
