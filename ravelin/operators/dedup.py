"""Deduplication and per-file limits. A null file name is a value of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import text as T


def once(df: DataFrame, *key: str) -> DataFrame:
    """Rows that are delivered again, whole, count once."""
    return df.dropDuplicates(list(key))


def chunk_key(text: Column, filename: Column, n: int = 400) -> Column:
    """What makes two chunks the same: their first n bytes without regard to case and white space, and their file."""
    return F.concat(T.first_bytes(F.coalesce(F.lower(T.collapsed(text)), F.lit("")), n), F.encode(F.concat(F.lit("|"), F.coalesce(F.lower(filename), F.lit("\u0000"))), "UTF-8"))


def without_copies(chunks: DataFrame, order: list[Column], n: int = 400) -> DataFrame:
    """Of chunks with the same key the first in order. The window keeps one row a key before it shuffles."""
    ranked = chunks.withColumn("__key", F.xxhash64(chunk_key(F.col("text"), F.col("filename"), n))).withColumn("__whole", F.sha2(chunk_key(F.col("text"), F.col("filename"), n), 256))
    return ranked.withColumn("__n", F.row_number().over(W.partitionBy("__key", "__whole").orderBy(*order))).where("__n = 1").drop("__key", "__whole", "__n")


def capped_per_file(chunks: DataFrame, path: str, order: list[Column], most: int | None = 50, core: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The first chunks of each file, all of those of core files. None: no limit."""
    if most is None:
        return chunks
    free = F.coalesce(T.contains_any(F.col(path), list(core)), F.lit(False))
    ranked = chunks.where(~free).withColumn("__n", F.row_number().over(W.partitionBy(path).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
    return ranked.unionByName(chunks.where(free)) if core else ranked
