"""Training-data operators: filters, deduplication, scoring, formatting and mixing.

Nothing else in the library imports this subpackage.
"""
