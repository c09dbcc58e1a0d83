"""Whole query plans: the hybrid engine, and the registered queries with their SQL."""
