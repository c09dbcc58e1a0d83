"""Capping records per dominant contributor (problem 5).

Mergeable bounded heaps: each map task keeps only the cap's best score-identifier pairs of each contributor, heaps are merged in a tree
(contributor and part, then contributor), and full records are joined with what's left. A heap is a set, so repeated rows count once
without a shuffle of their own; it never holds more than the cap, however many rows a contributor has. What's below the worst pair of a full heap
is left out before anything is sorted. A cap over HEAP, as a share of very many records can be, goes another exact way: distinct pairs are sorted in
ranges over all contributors, and a pair's place follows from its place in its range and the counts of the ranges before.

Defined results: a null contributor has no limit; null and NaN scores rank last; ties go to the smaller identifier; rows with a null
identifier are dropped; a repeated row counts once; an identifier that comes with several scores or contributors stays if one of its pairs does;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.runtime import broadcast_if_small, written

#: A map task passes its heaps on and starts again when they hold so many pairs; merging mends what that splits.
HELD = 400_000
#: Rows that wait for the heaps they go into, at least; as many as the heaps hold if that's more, so that sorting stays in proportion.
WAITING = 20_000
#: Parts of a contributor that are merged apart before they meet.
FAN = 16
#: A heap of more pairs than this isn't held in a task.
HEAP = 200_000


def _bounded(frames: Iterable[pd.DataFrame], cap: int) -> Iterator[pd.DataFrame]:
    """The heaps over all frames: the cap's best pairs (score, identifier) of each contributor."""

    def best(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates(["who", "last", "score", "id"]).sort_values(["who", "last", "score", "id"], ascending=[True, True, False, True], kind="stable")
        return x[x.groupby("who", sort=False).cumcount() < cap]

    def bar(heaps: pd.DataFrame) -> pd.DataFrame:
        """The worst pair of each full heap."""
        worst = heaps.groupby("who", sort=False).tail(1).set_index("who")[["last", "score"]]
        return worst[heaps.groupby("who", sort=False).size().reindex(worst.index).to_numpy() == cap]

    held: pd.DataFrame | None = None
    bars: pd.DataFrame | None = None
    waiting: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if bars is not None and len(bars) and len(frame):
            at = bars.index.get_indexer(frame["who"])
            last, score = (np.append(bars[c].to_numpy(), np.nan)[at] for c in ("last", "score"))  # at is -1 where there's no bar
            frame = frame[~((at >= 0) & ((frame["last"].to_numpy() > last) | ((frame["last"].to_numpy() == last) & (frame["score"].to_numpy() < score))))]
        waiting.append(frame)
        n += len(frame)
        if n > max(WAITING, 0 if held is None else len(held)):
            held = best(pd.concat(waiting if held is None else [held, *waiting], ignore_index=True))
            waiting, n = [], 0
            if len(held) > HELD:
                yield held
                held = bars = None
            else:
                bars = bar(held)
    if n or held is not None:
        held = best(pd.concat(waiting if held is None else [held, *waiting], ignore_index=True))
        if len(held):
            yield held


def _merged(frames: Iterable[pd.DataFrame], cap: int) -> Iterator[pd.DataFrame]:
    """As _bounded, of frames sorted by contributor: a heap is passed on when its contributor is over, so none is ever split."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        both = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(both):
            continue
        current = both["who"].to_numpy()[-1]
        over = (both["who"] != current).to_numpy()
        yield from _bounded([both[over]], cap)
        rest = next(_bounded([both[~over]], cap))
    if rest is not None and len(rest):
        yield rest


def _pairs(df: DataFrame, who: str, score: str, ident: str) -> DataFrame:
    """who, last, score, id: the pairs to be ranked."""
    nothing = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    pairs = df.select(F.col(who).alias("who"), nothing.cast("int").alias("last"), F.when(nothing, F.lit(0.0)).otherwise(F.col(score).cast("double")).alias("score"), F.col(ident).alias("id"))
    return pairs.where("who is not null and id is not null")


def _ranked(df: DataFrame, who: str, score: str, ident: str, cap: int) -> DataFrame:
    """As best_of_each, for a cap of any size: ranges of all pairs in order, and the place of each from counts of contributor and range."""
    pairs = _pairs(df, who, score, ident)
    order = ("who", "last", F.desc("score"), "id")
    ranges = pairs.distinct().repartitionByRange(*order).sortWithinPartitions(*order)

    def placed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, upto = None, 0
        for frame in frames:
            if not len(frame):
                continue
            names = frame["who"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            place = np.arange(len(frame)) - np.repeat(first, np.diff([*first, len(frame)]))
            if names[0] == current:
                place[: first[1] if len(first) > 1 else len(frame)] += upto
            current, upto = names[-1], int(place[-1]) + 1
            yield frame.assign(place=place)[["who", "id", "range", "place"]]

    schema = pairs.select("who", "id", F.lit(0).alias("range"), F.lit(0).cast("long").alias("place")).schema
    rows = written(ranges.withColumn("range", F.spark_partition_id()).mapInPandas(placed, schema), "ranked")
    counts = rows.groupBy("who", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("who", "range", (F.sum("n").over(W.partitionBy("who").orderBy("range")) - F.col("n")).alias("before"))
    # a contributor within one range starts there: only those of several have a row
    before = before.where("before > 0")
    return rows.join(broadcast_if_small(written(before, "before")), ["who", "range"], "left").where(F.col("place") + F.coalesce("before", F.lit(0)) < cap).select("who", "id")


def best_of_each(df: DataFrame, who: str, score: str, ident: str, cap: int) -> DataFrame:
    """who, id: what each contributor keeps, at most cap pairs. Rows without contributor or identifier are left out."""
    if cap > HEAP:
        return _ranked(df, who, score, ident, cap)
    pairs = _pairs(df, who, score, ident)
    schema = pairs.schema

    def heaps(f: Callable) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
        return lambda frames: f(frames, cap)

    mapped = pairs.mapInPandas(heaps(_bounded), schema)
    part = mapped.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    apart = part.repartition("who", "part").drop("part").sortWithinPartitions("who").mapInPandas(heaps(_merged), schema)
    return apart.repartition("who").sortWithinPartitions("who").mapInPandas(heaps(_merged), schema).select("who", "id")


def share_to_cap(df: DataFrame, ident: str, share: float) -> int:
    """The cap that a maximum share of all distinct records amounts to, at least 1."""
    return max(1, int(np.floor(share * df.select(ident).distinct().count())))


def capped(df: DataFrame, who: str = "filename", score: str = "score", ident: str = "id", cap: int | None = 20, share: float | None = None) -> DataFrame:
    """df's records, each once, as far as their contributor keeps them; all columns. With a share the smaller of both caps holds."""
    limits = [*([cap] if cap is not None else []), *([share_to_cap(df, ident, share)] if share is not None else [])]
    if not limits or min(limits) < 1:
        raise ValueError("give a cap of 1 or more, or a share")
    kept = best_of_each(df, who, score, ident, min(limits)).select(F.col("id").alias("__kept"))
    known = df.where(F.col(who).isNotNull() & F.col(ident).isNotNull())
    free = df.where(F.col(who).isNull() & F.col(ident).isNotNull())
    return known.join(kept, known[ident] == kept["__kept"], "left_semi").unionByName(free).dropDuplicates([ident])


def dropped(df: DataFrame, who: str = "filename", score: str = "score", ident: str = "id", cap: int = 20) -> DataFrame:
    """id: records that go, each once."""
    kept = best_of_each(df, who, score, ident, cap)
    return df.where(F.col(who).isNotNull()).select(F.col(ident).alias("id")).dropna().distinct().join(kept.select("id"), "id", "left_anti")
