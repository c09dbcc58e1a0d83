"""Hybrid document retrieval, its evaluation and its data preparation as DataFrame operators."""

__version__ = "0.1.0"
