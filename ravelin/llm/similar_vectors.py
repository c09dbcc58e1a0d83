"""Most similar vectors for every vector (problem 1).

Permutation index: pivots are vectors of the collection, and a vector is represented by its nearest pivots in order. It's posted in the
inverted files of those, the vectors that meet there are ranked by the footrule distance of their orders, and the best of them are reranked
by cosine. Pivots are drawn from the collection, so a dense region gets many and inverted files stay of one size; their number grows with
the collection up to PIVOTS, beyond which the inverted files grow. An inverted file that a sample shows to be much longer is cut into slices, and
each pair of slices is a block of its own. Equal vectors are one class, so copies are never compared with each other. Classes within NEAR of another one are a family
(scaled, re-encoded or jittered copies), of which the index has one entry. How far a family reaches bounds the cosines of its members, and
whatever can be among the nearest by those bounds is compared member by member, so that ties are settled among all members.

Every vector is indexed and every vector is a query. Approximate only in which candidates are found: the cosine of a pair is exact. Classes are
numbered in the order of their smallest identifiers, by which ties are settled everywhere.

Defined results: rows with an unusable vector or without identifier are no points; a repeated row counts once, and so does an identifier
that comes again with another vector (the one with the smaller bytes is used); ties go to the smaller identifier; a lone point has no
neighbours; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.vectors import directed, matrix, normed, sample
from ravelin.runtime import written

#: At most so many pivots: 4 MB of 64 numbers each, broadcast. PER_PIVOT vectors share a pivot below that.
PIVOTS = 16_384
PER_PIVOT = 16
#: Pivots that represent a vector, and candidates of an inverted file that are reranked.
ORDER = 10
RERANKED = 256
#: An inverted file with more entries than this, as the pivots' own orders let expect, is cut into slices of so many.
LONG = 10_000
#: A shuffle partition of inverted files for every so many entries at least: it's held in a task's memory.
PER_PART = 20_000
#: Queries of an inverted file looked at together.
AT_ONCE = 512
#: Cosines in single precision that may be equal at 6 decimals differ by less; exact ones computed together.
CLOSE, EXACT = 5e-6, 65_536
#: Distance of unit vectors up to which classes are a family. Families are looked for in cells: AXES directions in steps of WIDTH.
NEAR, AXES, WIDTH = 0.01, 10, 0.06
#: Members of a family compared with AT_ONCE queries together.
MEMBERS = 1024


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each unit row, nearest first."""
    out = np.empty((len(x), length), np.int32)
    for s in range(0, len(x), 2048):
        c = x[s : s + 2048] @ pivots.T
        near = np.argpartition(-c, length - 1, axis=1)[:, :length] if length < c.shape[1] else np.tile(np.arange(c.shape[1]), (len(c), 1))
        out[s : s + 2048] = np.take_along_axis(near, np.argsort(-np.take_along_axis(c, near, 1), axis=1, kind="stable"), 1)
    return out


def placed(pivots: np.ndarray, parts: int) -> np.ndarray:
    """The shuffle partition of each pivot's inverted file: as many pivots in each, pivots near each other together.

    A vector's nearest pivots are then in fewer partitions, and its entry is sent fewer times.
    """
    part = np.zeros(len(pivots), np.int64)
    todo = [(np.arange(len(pivots)), 0, parts)]
    while todo:
        mine, first, n = todo.pop()
        if n == 1 or len(mine) < 2:
            part[mine] = first
            continue
        x = pivots[mine]
        one = x[(x @ x.mean(axis=0)).argmin()]
        along = x @ (one - x[(x @ one).argmin()])
        half = n // 2
        order = np.argsort(along, kind="stable")
        cut = round(len(mine) * half / n)
        todo += [(mine[order[:cut]], first, half), (mine[order[cut:]], first + half, n - half)]
    return part


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Footrule distance of each order in a from each in b; a pivot that an order lacks counts as next after its last."""
    length = a.shape[1]
    shared = np.zeros((len(a), len(b)), np.int16)
    for i in range(length):
        for j in range(length):
            shared += (a[:, i, None] == b[None, :, j]) * np.int16(min(length - i, length - j))
    return length * (length + 1) - 2 * shared


def meeting(order: np.ndarray, x: np.ndarray, no: np.ndarray, reach: np.ndarray, asks: np.ndarray, there: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one inverted file: query, candidate, exact cosine and how far cosines of members may be from it, among the RERANKED nearest by footrule.

    Queries are the entries numbered in asks, candidates those in there. Of the single classes up to k for each query, ties by number; of pairs
    with a family all that can be among the k nearest of a member.
    """
    unit = normed(x)
    single = unit.astype(np.float32)
    for s in range(0, len(asks), AT_ONCE):
        q = asks[s : s + AT_ONCE]
        near = q[:, None] != there[None, :]
        if len(there) > RERANKED:  # of a shorter file all are reranked, whatever their distance
            far = np.where(near, footrule(order[q], order[there]), np.iinfo(np.int16).max)
            near &= far <= np.partition(far, RERANKED - 1, axis=1)[:, RERANKED - 1 : RERANKED]
        c = np.where(near, single[q] @ single[there].T, np.float32(-2))
        slack = reach[q, None] + reach[there] if reach.any() else np.float32(0)
        low = c - slack
        kth = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k] if k < c.shape[1] else np.float32(-9)
        i, j = np.nonzero(near & (c + slack >= np.maximum(kth, least) - np.float32(CLOSE)))
        i0, i, j = i, q[i], there[j]
        exact = np.round(np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", unit[i[t : t + EXACT]], unit[j[t : t + EXACT]]) for t in range(0, len(i), EXACT))]), 6)
        wide = reach[i].astype(np.float64) + reach[j]
        by = np.lexsort((no[j], -exact, wide > 0, i0))
        by = by[((np.arange(len(by)) - np.searchsorted(i0[by], i0[by]) < k) & (exact[by] >= least)) | (wide[by] > 0)]
        yield i[by], j[by], exact[by], wide[by]


def blocked(pivot: np.ndarray, own: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For postings of pivots whose files are cut into slices: which posting, block and side. Each pair of slices is a block of its own, side 2 is that
    of a slice with itself; a block has two slices at most, however long the file is."""
    which = np.repeat(np.arange(len(pivot)), slices)
    of = slices[which]
    other = np.arange(len(which)) - np.repeat(np.cumsum(slices) - slices, slices)
    low, high = np.minimum(own[which], other), np.maximum(own[which], other)
    return which, low * of + high, np.where(low == high, 2, np.where(own[which] == high, 1, 0)).astype(np.int8)


def led(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leader of each unit row and how far its family reaches, 0 for single rows: a row that isn't led leads what's left within NEAR of it."""
    leader, reach = np.full(len(x), -1), np.zeros(len(x))
    for i in range(len(x)):
        if leader[i] >= 0:
            continue
        free = np.flatnonzero(leader < 0)
        far = np.sqrt(((x[free] - x[i]) ** 2).sum(axis=1))
        mine = free[far <= NEAR]
        leader[mine] = i
        if len(mine) > 1:
            reach[mine] = far[far <= NEAR].max() * 1.00001 + 1e-8
    return leader, reach


def best_members(x: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of x, row of y, cosine: for each unit row of x the k most similar rows of y, of those equal at 6 decimals the first ones."""
    for s in range(0, len(x), AT_ONCE):
        q = x[s : s + AT_ONCE]
        cosine, member = np.full((len(q), k), -2.0), np.full((len(q), k), -1)
        left = np.arange(len(q))
        for h in range(0, len(y), MEMBERS):
            c = np.concatenate([cosine[left], np.round(q[left] @ y[h : h + MEMBERS].T, 6)], axis=1)
            m = np.concatenate([member[left], np.broadcast_to(np.arange(h, min(h + MEMBERS, len(y))), (len(left), min(MEMBERS, len(y) - h)))], axis=1)
            best = np.argsort(-c, axis=1, kind="stable")[:, :k]
            cosine[left], member[left] = np.take_along_axis(c, best, 1), np.take_along_axis(m, best, 1)
            left = left[cosine[left, -1] < 1]  # no later one is better than k of cosine 1
            if not len(left):
                break
        i, j = np.nonzero(member >= 0)
        yield s + i, member[i, j], cosine[i, j]


def neighbours(df: DataFrame, id_col: str = "id", vector_col: str = "vector", dims: int = 64, k: int = 10, least: float = 0.85, seed: int = 1, per_pivot: int = PER_PIVOT, order: int = ORDER) -> DataFrame:
    """id, neighbour, cosine (6 decimals), rank: up to k other points for each point, those of a cosine of at least `least`."""
    spark = df.sparkSession
    points = directed(df, id_col, vector_col, dims).groupBy("id").agg(F.min("vector").alias("vector"))
    points = written(points.select("id", F.unhex(F.md5("vector")).alias("key"), "vector"), "points")
    classes = written(_classes(points, dims), "classes")
    entries = classes.where("no = rep")
    pivots = sample(entries, min(PIVOTS, max(32, entries.count() // per_pivot)), seed, dims)
    length = min(order, len(pivots))
    # first identifiers of each class: with its own ones left out, no more can be among the k nearest
    firsts = points.select("key", "id").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    firsts = written(firsts.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(classes.select("key", "no"), "key").select("no", "ids"), "firsts")
    near = classes.where("reach = 0").select(F.col("no").alias("q"), F.col("no").alias("c"), F.lit(1.0).alias("cosine"))
    wide = entries.where("reach > 0").select(F.col("no").alias("q"), F.col("no").alias("c"))
    if length > 1:
        met = written(_index(spark, entries, pivots, length, dims, k, least), "met")
        near = near.unionByName(met.where("wide = 0").drop("wide"))
        wide = wide.unionByName(met.where("wide > 0").select("q", "c"))
    if not wide.isEmpty():
        near = near.unionByName(_between(classes, wide, dims, k, least))
    found = near.join(firsts.withColumnRenamed("no", "c"), "c").select("q", "cosine", F.explode("ids").alias("neighbour"))
    found = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))).alias("list"))
    mine = points.select("id", "key").join(classes.select("key", F.col("no").alias("q")), "key").select("id", "q").join(lists, "q")
    others = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("at", "x")).select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def _classes(points: DataFrame, dims: int) -> DataFrame:
    """key, no, vector, rep, reach: classes numbered in the order of their smallest identifiers, the number of the one that leads their family, and
    how far the family reaches, 0 for a single class."""
    spark = points.sparkSession
    first = points.groupBy("key").agg(F.min(F.struct("id", "vector")).alias("p")).select("key", "p.*")
    numbered = first.orderBy("id").select("key", F.monotonically_increasing_id().alias("no"), "vector")
    axes = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, min(AXES, dims))))[0]
    mix = np.random.default_rng(dims + 1).integers(1, 2**62, axes.shape[1])

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (np.floor(normed(matrix(batch.column(2), dims)) @ axes / WIDTH + 0.5).astype(np.int64) * mix).sum(axis=1) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["key", "no", "vector", "cell"])

    def families(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("cell", "ascending"), ("no", "ascending")])
        no, cell = t["no"].to_numpy(), t["cell"].to_numpy()
        rep, reach = no.copy(), np.zeros(len(no))
        edge = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0, [True])))
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                leader, reach[a:b] = led(normed(matrix(t["vector"][a:b].combine_chunks(), dims)))
                rep[a:b] = no[a:b][leader]
        t = t.drop_columns("cell").append_column("rep", pa.array(rep, pa.int64())).append_column("reach", pa.array(reach, pa.float64()))
        yield from t.to_batches(max_chunksize=10_000)

    cells = numbered.mapInArrow(celled, "key binary, no long, vector binary, cell long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), points.count() // PER_PART)
    return cells.repartition(parts, "cell").mapInArrow(families, "key binary, no long, vector binary, rep long, reach double")


def _between(classes: DataFrame, wide: DataFrame, dims: int, k: int, least: float) -> DataFrame:
    """q, c, cosine: for each class of each q of `wide` the k + 1 most similar classes, itself included, of each c."""
    wide = written(wide, "wide")
    asks = wide.join(classes.select(F.col("rep").alias("q"), "no", "vector"), "q").select("c", "no", "vector")
    held = classes.select(F.col("rep").alias("c"), F.col("no").alias("member"), F.col("vector").alias("there")).join(wide.select("c").distinct(), "c", "left_semi")

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("member")
        q, c, cosine = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            asking, member = a["no"].to_numpy(), b["member"].to_numpy()
            for i, j, x in best_members(*(normed(matrix(v.combine_chunks(), dims)) for v in (a["vector"], b["there"])), k + 1):
                ok = x >= least
                q.append(asking[i[ok]]), c.append(member[j[ok]]), cosine.append(x[ok])
        return pa.table([pa.array(np.concatenate(q), pa.int64()), pa.array(np.concatenate(c), pa.int64()), pa.array(np.concatenate(cosine), pa.float64())], ["q", "c", "cosine"])

    return asks.groupBy("c").cogroup(held.groupBy("c")).applyInArrow(compared, "q long, c long, cosine double")


def _index(spark, classes: DataFrame, pivots: np.ndarray, length: int, dims: int, k: int, least: float) -> DataFrame:  # noqa: ANN001
    """q, c, cosine, wide: the k best single classes that each entry meets in the inverted files (wide is 0), and what it meets of families."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() // PER_PART)
    entry = np.dtype([("no", "<i8"), ("reach", "<f4"), ("order", "<i4", length), ("vector", "<f4", dims)])
    post = np.dtype([("pivot", "<i4"), ("block", "<i8"), ("row", "<i4"), ("side", "i1")])
    load = np.bincount(orders(pivots, pivots, length).ravel(), minlength=len(pivots)) * (classes.count() / max(1, len(pivots)))
    slices = np.maximum(1, np.ceil(load / LONG)).astype(np.int64)
    held = spark.sparkContext.broadcast((pivots, slices, placed(pivots, parts)))

    def posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv, split, place = held.value
        for batch in batches:
            if not len(batch):
                continue
            rows = np.zeros(len(batch), entry)
            rows["no"], rows["reach"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows["vector"] = matrix(batch.column(2), dims)
            rows["order"] = orders(normed(rows["vector"]).astype(np.float32), piv, length)
            pivot = rows["order"].ravel()
            who = np.repeat(np.arange(len(rows)), length)
            many = split[pivot]
            mark = rows["no"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            which, block, side = blocked(pivot, (mark[who] % many.astype(np.uint64)).astype(np.int64), many)
            pivot, who = pivot[which], who[which]
            part = (place[pivot] + block) % parts
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for p in range(parts):
                mine = order[edge[p] : edge[p + 1]]
                if len(mine):
                    there, row = np.unique(who[mine], return_inverse=True)
                    x = np.zeros(len(mine), post)
                    x["pivot"], x["block"], x["row"], x["side"] = pivot[mine], block[mine], row, side[mine]
                    out.append((p, rows[there].tobytes(), x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], y) for j, y in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "entries", "postings"])

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, posts, n = [], [], 0
        for batch in batches:
            for e, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries.append(np.frombuffer(e, entry))
                posts.append(np.frombuffer(p, post).copy())
                posts[-1]["row"] += n
                n += len(entries[-1])
        if not entries:
            return
        e, p = np.concatenate(entries), np.concatenate(posts)
        entries.clear(), posts.clear()
        p = p[np.lexsort((p["side"], p["block"], p["pivot"]))]
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(p["pivot"]) != 0) | (np.diff(p["block"]) != 0), [True])))
        for a, b in zip(edge, edge[1:]):
            x, side = e[p["row"][a:b]], p["side"][a:b]
            sides = [np.flatnonzero(side == k) for k in range(3)]
            for asks, there in ((sides[2], sides[2]), (sides[0], sides[1]), (sides[1], sides[0])):
                if not len(asks) or not len(there):
                    continue
                for i, j, c, w in meeting(x["order"], x["vector"], x["no"], x["reach"], asks, there, k, least):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(x["no"][i]), pa.array(x["no"][j]), pa.array(c), pa.array(w)], ["q", "c", "cosine", "wide"])

    packed = classes.select("no", "reach", "vector").mapInArrow(posted, "part int, entries binary, postings binary")
    pairs = packed.repartitionById(parts, F.col("part")).select("entries", "postings").mapInArrow(met, "q long, c long, cosine double, wide double").distinct()
    alone = F.when(F.col("wide") > 0, F.col("c")).otherwise(-1)  # pairs with a family are all kept
    ranked = pairs.withColumn("n", F.row_number().over(W.partitionBy("q", alone).orderBy(F.desc("cosine"), "c")))
    return ranked.where(F.col("n") <= k).drop("n")


def neighbour_pairs(df: DataFrame, id_col: str = "id", vector_col: str = "vector", dims: int = 64, k: int = 10, least: float = 0.85) -> DataFrame:
    """id_a, id_b: pairs of points of which one at least has the other among its k most similar; the smaller identifier comes first."""
    n = neighbours(df, id_col, vector_col, dims, k, least)
    return n.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
