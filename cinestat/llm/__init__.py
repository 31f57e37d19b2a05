"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries. Nothing else in the library imports this
subpackage.
"""
