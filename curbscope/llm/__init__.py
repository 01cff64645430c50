"""Operators of a training-data pipeline: language ID, near-duplicates,
tokenizing, search, scoring, extraction and mixing.

Nothing else in the library imports this subpackage. Each module has one
operator with its own interface; ``queries.py`` holds the thin registered
queries and their SQL.
"""
