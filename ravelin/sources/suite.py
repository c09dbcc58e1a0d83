"""Test suites and results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.functions import rules

CASE = "test_id INT, category STRING, type STRING, question STRING, keywords ARRAY<STRING>, sources ARRAY<STRING>, refusal_patterns ARRAY<STRING>"


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of cases, numbered from 1. Missing settings get their defaults: type normal, empty lists, the usual refusals."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or []
    rows = [
        (n, c["category"], c.get("type") or "normal", c["question"], list(c.get("keywords") or []), list(c.get("sources") or []), list(c.get("refusal_patterns") or rules.REFUSALS))
        for n, c in enumerate(raw, 1)
    ]
    return spark.createDataFrame(rows, CASE)
