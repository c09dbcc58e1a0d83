"""Usable vectors, and classes of those that point the same way."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column, dims: int) -> Column:
    """Whether a vector has `dims` finite numbers that aren't all zero. Null vectors aren't usable."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def directed(df: DataFrame, id_col: str, vector_col: str, dims: int, *more: str | Column) -> DataFrame:
    """id, key, vector (binary, float32) and any further columns of rows with a usable vector and an identifier.

    key is the same for vectors whose directions agree to six decimals, whatever their lengths.
    """
    kept = df.where(usable(vector_col, dims)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"), *more).where("id is not null")
    kept = kept.where(usable("v", dims))  # doubles may leave the range of floats

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            x = matrix(batch.column(1), dims)
            raw = x.tobytes()
            unit = (np.round(normed(x), 6) + 0.0).astype(np.float32).tobytes()
            size = 4 * dims
            keys = pa.array([xxhash.xxh3_128_digest(unit[k : k + size]) for k in range(0, len(unit), size)], pa.binary())
            vectors = pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, vectors, *rest], ["id", "key", "vector", *batch.schema.names[2:]])

    rest = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[2:])
    return kept.mapInArrow(keyed, f"id {kept.schema['id'].dataType.simpleString()}, key binary, vector binary{rest}")


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """float32 rows of an Arrow column of lists or of binaries."""
    if pa.types.is_list(vectors.type) or pa.types.is_large_list(vectors.type):
        return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dims)
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float32).reshape(-1, dims)


def normed(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square leaves the range."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def sample(classes: DataFrame, n: int, seed: int, dims: int) -> np.ndarray:
    """Unit float32 vectors of at most n classes, chosen by a seeded hash of their keys. n bounds what the driver gets."""
    rows = classes.select("key", "vector").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(n).collect()
    return normed(np.frombuffer(b"".join(r["vector"] for r in rows), np.float32).reshape(-1, dims)).astype(np.float32) if rows else np.zeros((0, dims), np.float32)
