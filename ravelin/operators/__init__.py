"""Relational operators over chunk, query, posting and evaluation tables."""
