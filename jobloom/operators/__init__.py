"""Relational operators on postings, résumés and keyword counts."""
