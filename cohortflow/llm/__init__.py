"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries, one module per operator holds its general interface.
"""
