"""Mixing sources to target weights (problem 8).

Sainte-Laguë apportionment: the total is cut into blocks of equal tokens, and each goes to the source with the highest quotient
share / (2 x blocks so far + 1). A source stops at what it can give, its tokens times its highest number of repeats; blocks it can't fill
stay open and show as missing in the report, they don't inflate other sources. Which sources are short is read from the mix itself: those that
are used up, all of their tokens as often as allowed, below their share. Each source's quota is apportioned in the same way to its
shards (documents by a hash of their identifier), so that a source with a third of all documents is selected from in many tasks. A shard
uses all of its documents as often as its quota holds them whole, and a seeded selection of them once more; one that doesn't fit into the rest of
the quota is passed over for those after it that do.

Defined results: null texts have no tokens and aren't selected, empty ones have 0 and aren't either; a null source is no target; targets
with a null name are left out, a null share counts as 0 and null repeats as 1; a target named twice has its shares added and its larger repeats;
a source without documents reaches 0; repeated document rows count once; no documents or no targets give empty or zero results.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.llm.tokens import DEFAULT, token_count
from ravelin.runtime import written

#: Blocks the total is cut into; shares are met to within one block, as far as whole documents allow. Targets are a table of settings: more than this many is an error.
BLOCKS = 20_000
TARGETS = 10_000
#: Documents of a shard on average.
SHARD = 20_000


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats of each by highest quotient weight / (2 x seats so far + 1), none beyond its cap. Ties go to the one that comes first."""
    given = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    while seats > 0 and heap:
        _, k = heapq.heappop(heap)
        if caps is not None and given[k] >= caps[k]:
            continue
        given[k] += 1
        seats -= 1
        heapq.heappush(heap, (-weights[k] / (2 * given[k] + 1), k))
    return given


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = DEFAULT, shard: int = SHARD) -> DataFrame:
    """id, source, tokens, shard of each distinct document with a text, written to the shared folder: the text is encoded once."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(df.sparkSession, text_col, path).alias("tokens")).where("id is not null and tokens is not null")
    once = written(rows.dropDuplicates(["id"]), "tokens")
    shards = max(1, round(once.count() / shard))
    return once.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """One row per target: source, target_share, max_repeats, available (tokens of all its texts), total, block, seats (blocks won), quota (tokens).

    total defaults to the tokens of all documents, of any source. A source that can't reach its share gives all it has: its last block may be a part of one.
    """
    spark = docs.sparkSession
    wanted = targets.select(F.col("source").cast("string").alias("source"), F.coalesce("target_share", F.lit(0.0)).cast("double").alias("w"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("r")).where("source is not null")
    rows = sorted((r["source"], float(r["w"]), int(r["r"])) for r in wanted.groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("r")).limit(TARGETS + 1).collect())
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    tokens = F.sum("tokens").cast("long")
    have = {r["source"]: r["t"] for r in docs.join(F.broadcast(spark.createDataFrame(rows, "source string, w double, r int").select("source")), "source").groupBy("source").agg(tokens.alias("t")).collect()} if rows else {}
    whole = total if total is not None else docs.agg(tokens.alias("t")).first()["t"] or 0
    block = max(1, whole // blocks)
    seats = sainte_lague([w for _, w, _ in rows], whole // block)
    most = [max(0, r) * have.get(s, 0) for s, _, r in rows]
    quota = [m if m < w * whole else min(n * block, m) for (_, w, _), n, m in zip(rows, seats, most)]
    made = [(s, w, r, have.get(s, 0), whole, block, n, q) for (s, w, r), n, q in zip(rows, seats, quota)]
    return spark.createDataFrame(made, "source string, target_share double, max_repeats int, available long, total long, block long, seats long, quota long").coalesce(1)


def selected(docs: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """id, source, tokens, copies: the mix. Quotas of shards are apportioned by their tokens; planned is a bounded table (at most 10,000 rows)."""
    spark = docs.sparkSession
    parts = docs.where("tokens > 0").join(F.broadcast(planned.select("source", F.col("quota").alias("all_quota"), "block", "max_repeats")), "source")
    sizes = parts.groupBy("source", "shard").agg(F.sum("tokens").alias("size"), F.first("all_quota").alias("all_quota"), F.first("block").alias("block"), F.first("max_repeats").alias("max_repeats"))

    def apportion(frame):  # noqa: ANN001, ANN202 - the shards of one source
        frame = frame.sort_values("shard")
        block, whole = int(frame["block"].iloc[0]), int(frame["all_quota"].iloc[0])
        most = (frame["max_repeats"] * frame["size"]).tolist()
        quota = [n * block for n in sainte_lague(frame["size"].astype(float).tolist(), whole // block, [m // block for m in most])]
        rest = whole - sum(quota)  # less than a block, or more where shards are full but for parts of blocks
        for k, m in enumerate(most):
            more = min(m - quota[k], rest)
            quota[k] += more
            rest -= more
        return frame.assign(quota=quota)[["source", "shard", "size", "quota"]]

    shares = sizes.groupBy("source").applyInPandas(apportion, "source string, shard int, size long, quota long").where("quota > 0")
    rows = parts.select("id", "source", "shard", F.col("tokens").cast("long").alias("tokens"), F.xxhash64(F.lit(seed), "id").alias("place")).join(shares, ["source", "shard"])

    def filled(t: pa.Table) -> pa.Table:  # one shard of a source
        t = t.sort_by([("place", "ascending"), ("id", "ascending")])
        whole, rest = divmod(t["quota"][0].as_py(), t["size"][0].as_py())
        tokens = t["tokens"].to_pylist()
        copies = [whole] * len(tokens)
        left = []
        for k, n in enumerate(tokens):
            if n <= rest:
                copies[k] += 1
                rest -= n
            else:
                left.append(k)
        if left and tokens[least := min(left, key=tokens.__getitem__)] < 2 * rest:  # the smallest one left is in if more than half of it fits
            copies[least] += 1
        return t.select(["id", "source", "tokens"]).append_column("copies", pa.array(copies, pa.int32()))

    kind = rows.schema["id"].dataType.simpleString()
    mix = rows.groupBy("source", "shard").applyInArrow(filled, f"id {kind}, source string, tokens long, copies int")
    return mix.select("id", "source", F.col("tokens").cast(docs.schema["tokens"].dataType).alias("tokens"), "copies").where("copies > 0")


def report(mix: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target: source, target_share, share (of the mix), share_of_total (of the total aimed at), tokens, documents, most_copies, short: it's used up
    and still below its share."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = F.broadcast(planned).join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    all_ = W.partitionBy(F.lit(0))  # targets are few: a bounded table
    whole = F.sum("tokens").over(all_)
    used_up = F.col("tokens") >= F.greatest(F.col("max_repeats"), F.lit(0)) * F.col("available")
    short = used_up & (F.col("tokens") < F.col("target_share") * F.col("total"))
    return rows.select("source", "target_share", F.round(F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)), 6).alias("share"), F.round(F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)), 6).alias("share_of_total"), "tokens", "documents", "most_copies", short.alias("short"))
