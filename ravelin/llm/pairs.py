"""Pairs of records from pairs of their classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.runtime import broadcast_if_small, written

#: Members of a class that are held together: a larger class is split into pieces, and pieces are joined in pairs.
PIECE = 5_000


def member_pairs(sides: DataFrame, members: DataFrame, piece: int = PIECE, lone: bool = False) -> DataFrame:
    """id_a, id_b: the members (id, key) of linked classes (a, b), the smaller identifier first, each pair once. Classes may be linked with themselves.

    lone: sides and members have no row twice, so a pair can only come twice if one of its identifiers is in several classes. Only such pairs are made
    distinct by a shuffle then; the others, whose number can be the square of the members', go straight to the result. Only classes of more than one piece have a row in the table that's broadcast, at most one for every so many records.
    """
    members = written(members, "members", forget=lone)
    large = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("pieces")).where("pieces > 1")
    large = broadcast_if_small(written(large, "large"))
    split = members.join(large, "key", "left").select("key", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0)).alias("p"))
    every = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)).alias(side)
    left = sides.join(large.withColumnRenamed("key", "a"), "a", "left").select("a", "b", every("i"))
    both = left.join(large.withColumnRenamed("key", "b"), "b", "left").select("a", "b", "i", every("j")).where("a <> b or i <= j")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        x = both.join(left.select(F.col("key").alias("a"), F.col("p").alias("i"), F.col("id").alias("x")), ["a", "i"])
        xy = x.join(right.select(F.col("key").alias("b"), F.col("p").alias("j"), F.col("id").alias("y")), ["b", "j"])
        return xy.where("x <> y and (a <> b or i < j or x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    if not lone:
        return met(split, split).distinct()
    several = written(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "several", forget=True)
    if several.isEmpty():
        return met(split, split)
    several = broadcast_if_small(several)
    single, multiple = written(split.join(several, "id", "left_anti"), "single", forget=True), written(split.join(several, "id", "left_semi"), "multiple", forget=True)
    return met(single, single).union(met(multiple, multiple).union(met(single, multiple)).union(met(multiple, single)).distinct())
