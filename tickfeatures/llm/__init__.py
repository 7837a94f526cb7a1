"""Operators of a training-data pipeline over document, page and conversation tables.

Each module holds one operator with a general interface; ``queries`` binds them to
the test tables. Nothing else in the library imports this subpackage.
"""
