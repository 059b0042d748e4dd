"""Operators for building training data from documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
