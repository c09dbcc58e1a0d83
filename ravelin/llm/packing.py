"""Filling fixed-capacity containers with items (problem 7).

Harmonic packing: an item of more than capacity/(m+1) and at most capacity/m tokens belongs to class m, and a container opened for class m
takes m of its items. Items are spread over shards of bounded size by a hash of their identifier, and each shard packs its own classes, so
neither a hot source nor growth reaches a single task. A container with room left after its m items is topped up with the largest items of
finer classes that fit, found through a bit set of the lengths still there; without that, classes 1 to 3 would leave up to half empty.

Defined results: null and empty texts and null identifiers give nothing; repeated identifiers are packed each time they occur, so give
distinct rows; an empty table gives an empty result; a text larger than the capacity is cut into full pieces, its last one an item like any
other; equal lengths go in the order of identifiers and pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.tokens import DEFAULT, sized
from ravelin.runtime import written

#: Items of a shard on average. Its last container of each finest class may stay open, so a shard should have thousands of items.
SHARD = 50_000


def harmonic(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers. Lengths are between 1 and the capacity."""
    of: dict[int, list[int]] = defaultdict(list)
    for k, n in enumerate(lengths):
        of[n].append(k)
    for items in of.values():
        items.reverse()  # pop() gives the first
    there = 0
    for n in of:
        there |= 1 << n
    bins: list[list[int]] = []
    while there:
        room, held = capacity, []
        first = there.bit_length() - 1  # the largest left opens a container of its class
        most, least = capacity // first, capacity // (capacity // first + 1)  # class m holds lengths above `least`
        while most and (fits := there & ((2 << room) - 1)):
            n = fits.bit_length() - 1
            if n <= least:
                break
            held.append(of[n].pop())
            room -= n
            most -= 1
            if not of[n]:
                there ^= 1 << n
        while fits := there & ((2 << room) - 1):  # topping up
            n = fits.bit_length() - 1
            held.append(of[n].pop())
            room -= n
            if not of[n]:
                there ^= 1 << n
        bins.append(held)
    return bins


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = DEFAULT, shard: int = SHARD) -> DataFrame:
    """container STRING, slot, id, piece, pieces, tokens, char_start, char_end: what each container holds, by code points of the stored text."""
    items = written(sized(df, id_col, text_col, capacity, path), "sizes")
    shards = max(1, round(items.count() / shard))
    spread = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int")).repartition(max(1, min(shards, 20_000)), "shard").sortWithinPartitions("shard")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.sort_by([("id", "ascending"), ("piece", "ascending")])
            bins = harmonic(table["tokens"].to_pylist(), capacity)
            name = table["shard"][0].as_py()
            table = table.take(pa.array([k for b in bins for k in b], pa.int64()))
            names = pa.array([f"{name}-{j}" for j, b in enumerate(bins) for _ in b], pa.string())
            slots = pa.array([k for b in bins for k in range(len(b))], pa.int32())
            yield from pa.table([names, slots, *(table[c] for c in ("id", "piece", "pieces", "tokens", "char_start", "char_end"))], names=["container", "slot", "id", "piece", "pieces", "tokens", "char_start", "char_end"]).combine_chunks().to_batches()

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard_of = table["shard"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard_of)) + 1), len(shard_of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held[0]["shard"][0].as_py() != shard_of[a]:
                    yield from one(pa.concat_tables(held))
                    held = []
                held.append(table.slice(a, b - a))
        if held:
            yield from one(pa.concat_tables(held))

    kind = items.schema["id"].dataType.simpleString()
    return spread.mapInArrow(pack, f"container string, slot int, id {kind}, piece int, pieces int, tokens long, char_start long, char_end long")


def fill_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, items, tokens, fill: how full the containers are on the whole, and full_95: the share of those filled to 95 % or more."""
    each = containers.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.lit(capacity) / F.count(F.lit(1)), 6).alias("fill"), F.round(F.avg((F.col("t") >= 0.95 * capacity).cast("double")), 6).alias("full_95"))
