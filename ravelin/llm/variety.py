"""Choosing a varied subset (problem 4).

Distributed farthest-first k-center. Round one: points are spread by a hash over parts of bounded size, and each part selects several times
its share by farthest-first. Round two: what the parts selected is pooled and divided by nearest centres, so that like vectors are in one
cell whichever part they came from, and farthest-first runs again in each cell, noting how far each pick was from all picks before it. The
picks that were farthest make the subset; that's what farthest-first over the whole pool would choose, but for neighbours across a cell's
edge. A pool that fits one cell is one, then the rerun is exact. Each pooled point knows how many points it stands for, and of points that
are about equally far the rerun picks the one that stands for most: else single outliers, which are farthest of all, would push out whole
kinds of vectors.

Big groups of like vectors can't weigh too much, for a pick inside one is near earlier picks. A value of the label column is limited to a
share of the subset, as long as others are left.

Defined results: unusable vectors and null identifiers are left out; repeated rows and vectors of one direction count once (the smallest
identifier stands for them); null labels have no limit; ties go to the smaller identifier; fewer points than wanted are all chosen; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.vectors import directed, normed, sample
from ravelin.runtime import broadcast_if_small, written

#: Points of a part in round one, of a cell in round two.
PART = 8192
CELL = 16_384
#: How many times its share a part selects.
OVER = 3
#: A heavier point, one that stands for more, is picked if it's no more than this share nearer than the farthest.
SLACK = 0.15
#: At most so many centres: 1 MB of 64 numbers each. Beyond, cells grow and are divided by up to SIDES planes each.
CENTRES, SIDES = 4096, 16
#: Steps of distance by which the limit is looked for: a bounded histogram.
STEPS = 1 << 16


def farthest_first(x: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of n rows of unit vectors, each among the farthest from those before, and how far the farthest was. The first row counts as 2 away.

    Without weights it's always the farthest, ties going to the first row; with them the heaviest of those within SLACK of the farthest.
    """
    n = min(n, len(x))
    picks, radius = np.empty(n, np.int64), np.empty(n)
    near = np.full(len(x), -1.0, np.float32)
    for k in range(n):
        low = float(near.min())
        if weight is None:
            pick = int(near.argmin())
        else:
            pick = int(np.where(near <= 1 - (1 - SLACK) ** 2 * (1 - low), weight - near, -np.inf).argmax())
        picks[k], radius[k] = pick, np.sqrt(max(0.0, 2 - 2 * low))
        np.maximum(near, x @ x[pick], out=near)
        near[pick] = np.inf
    return picks, radius


def density(x: np.ndarray, within: float) -> np.ndarray:
    """For each row how many rows are no farther than `within`, itself among them."""
    return np.concatenate([(x[s : s + 1024] @ x.T >= np.float32(1 - within**2 / 2)).sum(axis=1) for s in range(0, len(x), 1024)]).astype(np.float32)


def represented(x: np.ndarray, picks: np.ndarray, within: float) -> np.ndarray:
    """For each pick the rows that are nearest to it and no farther than `within`, itself among them."""
    count = np.zeros(len(picks))
    for s in range(0, len(x), 2048):
        c = x[s : s + 2048] @ x[picks].T
        best = c.argmax(axis=1)
        close = c[np.arange(len(c)), best] >= 1 - within**2 / 2
        count += np.bincount(best[close], minlength=len(picks))
    return np.maximum(count, 1)


def _selecting(share: float | None, dims: int, column: str):  # noqa: ANN202
    """For each value of `column`, whose rows come together, its picks with how far they were and how many rows they stand for.

    With a share it's round one: plain farthest-first tells how far apart so many picks are, half of which counts as like; rows with many like
    ones are preferred, and OVER times the share is selected. Without, it's round two: rows in order, by the weights from round one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).sort_by([("id", "ascending")])
            x = normed(np.frombuffer(b"".join(t["vector"].to_pylist()), np.float32).reshape(-1, dims)).astype(np.float32)
            weight = t["weight"].to_numpy().astype(np.float32)
            if share is not None:
                within = farthest_first(x, int(np.ceil(share * len(x))))[1][-1] / 2
                picks, radius = farthest_first(x, OVER * int(np.ceil(share * len(x))), density(x, within))
                weight = represented(x, picks, within)
            else:
                picks, radius = farthest_first(x, len(x), weight)
                weight = weight[picks]
            t = t.take(pa.array(picks))
            return pa.RecordBatch.from_arrays([t["id"].combine_chunks(), t["vector"].combine_chunks(), t["label"].combine_chunks(), pa.array(weight, pa.float64()), pa.array(radius)], ["id", "vector", "label", "weight", "radius"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(column).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held[0].column(column)[0].as_py() != of[a]:
                    yield one(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield one(held)

    return run


def varied_subset(df: DataFrame, id_col: str = "id", vector_col: str = "vector", label: str = "payload.filename", dims: int = 64, share: float = 0.05, label_share: float = 0.02, seed: int = 4) -> DataFrame:
    """id, label, radius: a varied subset of `share` of the usable points (rounded up), no label in it more than label_share of it.

    radius is the distance (of unit vectors) that the point had from those chosen before it in its cell. The limit of a label is lifted, in
    order of radius, only if the pool's other labels can't fill the subset.
    """
    rows = directed(df, id_col, vector_col, dims, F.col(label).cast("string").alias("label"))
    # copies and repeated rows: the class's smallest identifier, with the row it comes in
    points = rows.groupBy("id").agg(F.min(F.struct("vector", "key", F.col("label").isNull().alias("none"), "label")).alias("p")).select("id", "p.*")
    points = written(points, "points")
    n = points.count()
    wanted = int(np.ceil(share * n))
    classes = written(points.groupBy("key").agg(F.min(F.struct("id", "vector", "label")).alias("p")).select("key", "p.*"), "classes")
    distinct = classes.count()
    schema = f"id {points.schema['id'].dataType.simpleString()}, vector binary, label string, weight double, radius double"
    pool = classes.select("id", "vector", "label", "key", F.lit(1.0).alias("weight"))
    if 0 < OVER * wanted < distinct:
        parts = int(np.ceil(distinct / PART))
        cut = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(parts)).cast("int")).repartition(min(parts, 20_000), "part").sortWithinPartitions("part")
        pool = written(cut.select("id", "vector", "label", "weight", "part").mapInArrow(_selecting(wanted / distinct, dims, "part"), schema), "pool").withColumn("key", F.md5("vector").cast("binary"))
    pooled = pool.count()
    cells = max(1, int(np.ceil(pooled / CELL)))
    if cells > 1:
        cells = min(CENTRES, 4 * cells)
        centres = sample(pool, cells, seed, dims)
        held = df.sparkSession.sparkContext.broadcast(centres)

        directions = np.random.default_rng(seed).normal(size=(dims, SIDES)).astype(np.float32)

        @F.arrow_udf("struct<c: int, sides: int>")
        def nearest(vectors: pa.Array) -> pa.Array:
            x = normed(np.frombuffer(b"".join(vectors.to_pylist()), np.float32).reshape(-1, dims)).astype(np.float32)
            c = (x @ held.value.T).argmax(axis=1)
            sides = ((x - held.value[c]) @ directions > 0) @ (1 << np.arange(SIDES))
            return pa.StructArray.from_arrays([pa.array(c, pa.int32()), pa.array(sides, pa.int32())], ["c", "sides"])

        celled = written(pool.select("id", "vector", "label", "weight", "key", nearest("vector").alias("x")).select("id", "vector", "label", "weight", "key", "x.c", "x.sides"), "celled")
        # a cell of several times CELL is divided by the sides of planes through its centre, so that like vectors stay together; what even that leaves too large by a hash
        planes = celled.groupBy("c").agg(F.least(F.ceil(F.log2(F.count(F.lit(1)) / F.lit(CELL))), F.lit(SIDES)).alias("planes")).where("planes > 0")
        celled = celled.join(broadcast_if_small(planes), "c", "left").withColumn("part", F.expr(f"c * {1 << SIDES}L + (sides & (shiftleft(1, cast(coalesce(planes, 0) AS int)) - 1))"))
        celled = written(celled.select("id", "vector", "label", "weight", "key", "part"), "parts")
        pieces = celled.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * CELL)).alias("pieces")).where("pieces > 1")
        celled = celled.join(broadcast_if_small(pieces), "part", "left").withColumn("cell", F.col("part") * 4099 + F.pmod(F.xxhash64("key"), F.coalesce("pieces", F.lit(1))))
    else:
        celled = pool.withColumn("cell", F.lit(0).cast("long"))
    ordered = celled.select("id", "vector", "label", "weight", "cell").repartition(min(max(cells, -(-pooled // CELL)), 20_000), "cell").sortWithinPartitions("cell")
    ordered = written(ordered.mapInArrow(_selecting(None, dims, "cell"), schema).select("id", "label", "radius"), "ordered")
    most = max(1, int(np.ceil(label_share * wanted)))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("radius"), "id"))
    within = ordered.where("label is not null").withColumn("place", place).where(F.col("place") <= most).drop("place").unionByName(ordered.where("label is null"))
    within = written(within, "within")
    have = within.count()
    if have >= wanted:
        return _first(within, wanted)
    rest = ordered.join(within.select("id"), "id", "left_anti")
    return within.unionByName(_first(rest, wanted - have))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of the largest radius, ties by identifier, found through a histogram, so that no task sorts all of them."""
    step = F.floor(F.col("radius") * (STEPS / 2)).cast("int")
    hist = pd.DataFrame(rows.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), columns=["s", "n"]).sort_values("s", ascending=False)
    upto = hist["n"].cumsum()
    whole = hist[upto <= n]
    above = rows.where(step >= int(whole["s"].min())) if len(whole) else rows.limit(0)
    left = n - int(whole["n"].sum())
    if left <= 0 or len(whole) == len(hist):
        return above
    edge = int(hist["s"].iloc[len(whole)])
    return above.unionByName(rows.where(step == edge).orderBy(F.desc("radius"), "id").limit(left))
