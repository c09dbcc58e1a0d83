"""Functions for SQL: temporary ones of a session, inlined by the optimizer, and the chunking table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ravelin.functions import rules
from ravelin.operators import chunking


def register(spark: SparkSession) -> None:
    """cosine(a, b), folded(text), bm25_part(idf, tf, dl, avgdl) and the table function chunk_text(text, size, overlap, prefix)."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    a, b, ab = dot.format("a", "a"), dot.format("b", "b"), dot.format("a", "b")
    accents, plain = rules.ACCENTED, rules.UNACCENTED
    for name, body in {
        "cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": f"CASE WHEN size(a) = size(b) THEN CASE WHEN {a} * {b} = 0 THEN 0D ELSE {ab} / sqrt({a} * {b}) END END",
        "folded(t STRING) RETURNS STRING": f"translate(lower(t), '{accents}', '{plain}')",
        "bm25_part(idf DOUBLE, tf DOUBLE, dl DOUBLE, avgdl DOUBLE) RETURNS DOUBLE": "idf * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / avgdl))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
    chunking.register(spark)
