"""Operators for the preparation of language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one operator
and registers the query that applies it to its whole table.
"""
