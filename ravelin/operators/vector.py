"""Vector search for many questions at once: one matrix product for each block of vectors and questions, and k candidates a task and question to
shuffle. The exact search is one scan; a written index of cells lets a question read part of the vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Questions answered in one job: their matrix is broadcast, so they're counted first. More go in several calls.
MAX_QUERIES = 20_000
#: Vectors and questions compared at once.
ROWS, COLUMNS = 4096, 1024
#: Vectors that cells are made from, and cells at most: both are held by the driver.
SAMPLE, MAX_CELLS = 65_536, 4096


def topk(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", query_vector: str = "qvec") -> DataFrame:
    """query_id, id, cosine (6 decimals), rank: the k nearest chunks of each question, ties to the smaller identifier.

    Chunks and questions without a vector, or with one of another size than the questions' first, have no hits; a zero vector's cosine is 0.
    """
    asked = queries.where(F.col(query_vector).isNotNull()).select("query_id", F.col(query_vector).cast("array<double>").alias("v")).limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} questions at once")
    kind, ident = queries.schema["query_id"].dataType.simpleString(), chunks.schema[id_col].dataType.simpleString()
    dims = len(asked[0]["v"]) if asked else 0
    asked = [a for a in asked if len(a["v"]) == dims and None not in a["v"]]
    schema = f"query_id {kind}, id {ident}, cosine double"
    if not asked or not dims:
        return chunks.sparkSession.createDataFrame([], schema + ", rank int")
    q = np.array([a["v"] for a in asked])
    size = np.linalg.norm(q, axis=1, keepdims=True)
    held = chunks.sparkSession.sparkContext.broadcast(([a["query_id"] for a in asked], np.divide(q, size, out=np.zeros_like(q), where=size > 0)))
    arrow = to_arrow_schema(chunks.sparkSession.createDataFrame([], schema).schema)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = held.value
        best = Best(len(names), k)
        for batch in batches:
            if len(batch):
                best.add(batch.column(0).to_pylist(), normed(batch.column(1), dims), unit)
        yield from best.rows(names, arrow)

    by = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return sized(chunks, id_col, vector, dims).mapInArrow(near, schema).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def sized(chunks: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """id, v: rows with an identifier and a vector of `dims` numbers."""
    numbers = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return chunks.where((F.size(vector) == dims) & numbers & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))


def normed(vectors: pa.Array, dims: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Best:
    """The k best of each question so far, ties to the smaller identifier: two arrays of k rows and a column a question, merged a block at a time."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.ids = k, []
        self.score = np.full((k, questions), -np.inf)
        self.place = np.full((k, questions), -1)  # in ids

    def add(self, ids: list, unit: np.ndarray, asked: np.ndarray, columns: np.ndarray | None = None) -> None:
        """Rows of unit vectors, compared with all questions or with those numbered in columns."""
        columns = np.arange(len(asked)) if columns is None else columns
        begin = len(self.ids)
        self.ids += ids
        for r in range(0, len(ids), ROWS):
            for s in range(0, len(columns), COLUMNS):
                mine = columns[s : s + COLUMNS]
                self._merge(np.round(unit[r : r + ROWS] @ asked[mine].T, 6) + 0.0, begin + r, mine)
        if len(self.ids) < 2 * self.place.size + 50_000:
            return
        kept, place = np.unique(self.place, return_inverse=True)  # identifiers that nothing holds any more are let go
        self.ids = [self.ids[i] if i >= 0 else None for i in kept]
        self.place = np.where(self.place >= 0, place.reshape(self.place.shape), -1)

    def _merge(self, new: np.ndarray, begin: int, mine: np.ndarray) -> None:
        low = self.score[:, mine].min(axis=0)
        some = np.flatnonzero((new >= low).any(axis=0))  # questions that this block has anything for
        if not len(some):
            return
        mine, new = mine[some], new[:, some]
        score = np.concatenate((self.score[:, mine], new))
        place = np.concatenate((self.place[:, mine], np.broadcast_to(np.arange(begin, begin + len(new))[:, None], new.shape)))
        top = np.argpartition(-score, self.k - 1, axis=0)[: self.k]
        least = np.take_along_axis(score, top, 0).min(axis=0)
        tied = np.flatnonzero(((score >= least).sum(axis=0) > self.k) & np.isfinite(least))
        for j in tied:  # more than k reach the k-th's score: the smaller identifiers among those that equal it
            sure, equal = np.flatnonzero(score[:, j] > least[j]), np.flatnonzero(score[:, j] == least[j])
            top[:, j] = [*sure, *sorted(equal, key=lambda i: self.ids[place[i, j]])[: self.k - len(sure)]]
        self.score[:, mine], self.place[:, mine] = np.take_along_axis(score, top, 0), np.take_along_axis(place, top, 0)

    def rows(self, names: list, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        held = self.place >= 0
        for s in range(0, len(names), COLUMNS):
            i, j = np.nonzero(held[:, s : s + COLUMNS])
            if len(i):
                place, score = self.place[i, s + j], self.score[i, s + j]
                yield pa.RecordBatch.from_arrays([pa.array([names[s + x] for x in j], arrow.field(0).type), pa.array([self.ids[p] for p in place], arrow.field(1).type), pa.array(score)], schema=arrow)


@dataclass(frozen=True)
class Cells:
    """A written index of vectors: centres (cell, centre) and vectors (id, v, cell), partitioned by cell."""

    centres: DataFrame
    vectors: DataFrame


def centres_of(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of n groups of unit vectors by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(sample[s : s + 4096] @ c.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def probes_for(sample: np.ndarray, centres: np.ndarray, seed: int, share: float = 0.96, asked: int = 256, k: int = 10) -> int:
    """How many cells a question has to meet so that the cells of `share` of its k nearest are among them, measured on vectors of the sample against
    the whole sample. Vectors without groups need most cells: then the exact search costs no more."""
    if len(sample) < 2 or len(centres) < 2:
        return len(centres)
    q = sample[np.random.default_rng(seed).choice(len(sample), min(asked, len(sample)), replace=False)]
    of = np.concatenate([(sample[s : s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    near = np.argpartition(-(q @ sample.T), min(k, len(sample) - 1), axis=1)[:, : k + 1]  # each is among its own
    needed = np.sort(np.take_along_axis(rank, of[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))]) + 1


def build_cells(chunks: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", cells: int | None = None, seed: int = 3) -> None:
    """Writes an inverted file of cells: each vector goes to its nearest centre, and every vector is indexed.

    Centres come from a sample of at most SAMPLE vectors; there are as many as the square root of all vectors, up to MAX_CELLS. Vectors of another size
    than the largest are left out, as they are by the exact search for questions of that size.
    """
    spark = chunks.sparkSession
    seen = chunks.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector)).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    dims, n = seen["dims"] or 0, seen["n"]
    rows = sized(chunks, id_col, vector, dims)
    drawn = rows.select("v").where(F.rand(seed) < min(1.0, 1.2 * SAMPLE / max(1, n))).limit(SAMPLE).collect()
    unit = np.array([r["v"] for r in drawn], np.float64).reshape(-1, max(1, dims))
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
    count = max(1, min(MAX_CELLS, int(np.sqrt(n)), len(unit))) if cells is None else min(cells, max(1, len(unit)))
    centres = centres_of(unit, count, seed=seed) if len(unit) else np.zeros((1, max(1, dims)))
    probes = probes_for(unit, centres, seed)
    held = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = normed(vectors, dims)
        return pa.array(np.concatenate([np.zeros(0, np.int64), *((x[s : s + 4096] @ held.value.T).argmax(axis=1) for s in range(0, len(x), 4096))]), pa.int32())

    placed = rows.withColumn("cell", nearest("v"))
    # cells are spread over tasks by cell and a salt, so that a large one isn't written by one task
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(k, [float(x) for x in c], probes) for k, c in enumerate(centres)], "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def open_cells(spark, path: str, id_type: str = "string") -> Cells:  # noqa: ANN001
    return Cells(spark.read.parquet(f"{path}/centres"), spark.read.schema(f"id {id_type}, v array<double>, cell int").parquet(f"{path}/vectors"))


def indexed_topk(cells: Cells, queries: DataFrame, k: int, probes: int | None = None, query_vector: str = "qvec") -> DataFrame:
    """query_id, id, cosine, rank: as topk, but each question only meets the vectors of its nearest cells: as many as were measured to hold 96 % of the
    ten nearest when the cells were made, unless probes says how many. Cosines are exact; some of the nearest may be missed. Cells that no question is
    near to aren't read.
    """
    spark = cells.vectors.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull()).select("query_id", F.col(query_vector).cast("array<double>").alias("v")).limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} questions at once")
    stored = cells.centres.collect()  # at most MAX_CELLS
    centres = sorted((r["cell"], r["centre"]) for r in stored)
    dims = len(centres[0][1])
    asked = [a for a in asked if len(a["v"]) == dims and None not in a["v"]]
    kind, ident = queries.schema["query_id"].dataType.simpleString(), cells.vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {ident}, cosine double"
    if not asked:
        return spark.createDataFrame([], schema + ", rank int")
    q = np.array([a["v"] for a in asked])
    size = np.linalg.norm(q, axis=1, keepdims=True)
    unit = np.divide(q, size, out=np.zeros_like(q), where=size > 0)
    probes = min(len(centres), stored[0]["probes"] if probes is None else probes)
    near = np.argsort(-(unit @ np.array([c for _, c in centres]).T), axis=1, kind="stable")[:, :probes]
    of = {centres[c][0]: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    held = spark.sparkContext.broadcast(([a["query_id"] for a in asked], unit, of))
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit, of = held.value
        best = Best(len(names), k)
        for batch in batches:
            cell = batch.column(2).to_numpy()
            for c in np.unique(cell):
                mine = batch.filter(pa.array(cell == c))
                best.add(mine.column(0).to_pylist(), normed(mine.column(1), dims), unit, of[int(c)])
        yield from best.rows(names, arrow)

    read = cells.vectors.where(F.col("cell").isin([int(c) for c in of])).select("id", "v", "cell")
    by = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return read.mapInArrow(search, schema).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
