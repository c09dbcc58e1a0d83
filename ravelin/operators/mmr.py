"""Diversification: maximal marginal relevance with limits per file. Greedy, so a function over each question's pool of a dozen rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

#: What a row loses once its file has its number of rows.
PENALTY = 0.5


def pick_order(score: np.ndarray, files: list, vectors: list, k: int, per_file: int | None = 2, trade: float | None = 0.7, by_vectors: bool = True) -> list[int]:
    """Row numbers in the order they're picked. Rows come best first; ties go to the first.

    A row's worth is trade * score less (1 - trade) * its largest cosine with a row picked before, less 0.5 if its file has per_file rows
    already. A row whose file has twice as many is dropped when it comes up, as long as enough others are left. 0 stands for the defaults (2 and
    0.7), None turns the limit or the penalty off.
    """
    limit = np.inf if per_file is None else (per_file if per_file > 0 else 2)
    trade = 1.0 if trade is None else (trade if trade > 0 else 0.7)
    n = len(score)
    known = np.array([v is not None for v in vectors], bool)
    size = max((len(v) for v in vectors if v is not None), default=1)
    x = np.zeros((n, size))
    for i in np.flatnonzero(known):
        x[i, : len(vectors[i])] = vectors[i]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    likest = np.full(n, -np.inf)
    left = np.ones(n, bool)
    held: dict = {}
    picked: list[int] = []
    while len(picked) < k and left.any():
        worth = trade * score
        if by_vectors and trade < 1:
            worth = worth - (1 - trade) * np.where(known & np.isfinite(likest), likest, 0.0)
        worth = worth - np.array([PENALTY if held.get(f, 0) >= limit else 0.0 for f in files])
        i = int(np.where(left, worth, -np.inf).argmax())
        left[i] = False
        if held.get(files[i], 0) >= 2 * limit and len(picked) + int(left.sum()) >= k:
            continue
        picked.append(i)
        held[files[i]] = held.get(files[i], 0) + 1
        if known[i]:
            likest = np.maximum(likest, unit @ unit[i])
    return picked


def diversified(candidates: DataFrame, k: int, per_file: int | None = 2, trade: float | None = 0.7) -> DataFrame:
    """Candidates (query_id, id, filename, score, embedding, has_vector: whether the question has one) that are picked, with their rank."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        vectors = [None if v is None else np.asarray(v, float) for v in frame["embedding"]]
        order = pick_order(frame["score"].to_numpy(float), frame["filename"].tolist(), vectors, k, per_file, trade, bool(frame["has_vector"].iloc[0]))
        return frame.iloc[order].assign(rank=np.arange(1, len(order) + 1, dtype=np.int32))

    return candidates.groupBy("query_id").applyInPandas(run, StructType([*candidates.schema.fields, StructField("rank", IntegerType())]))
