"""Captured answer streams: lines of server-sent events as rows, and rows as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as T

SCHEMA = "type STRING, text STRING, sources ARRAY<STRUCT<filename: STRING, score: DOUBLE, text: STRING>>, metrics STRUCT<search_time: STRING, gen_time: STRING, total_time: STRING>"
DONE = "[DONE]"


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with their event: type, text, sources, metrics; other columns stay. Lines that aren't data, or no JSON, are left out; the end mark has type [DONE]."""
    body = F.btrim(F.substring(F.btrim(F.col(line)), 6, 2**31 - 1))
    rows = lines.where(F.btrim(F.col(line)).startswith("data:")).withColumn("__e", F.from_json(body, SCHEMA)).withColumn("__done", body == DONE)
    kept = rows.where(F.col("__done") | F.col("__e.type").isNotNull())
    event = [F.when(F.col("__done"), F.lit(DONE)).otherwise(F.col("__e.type")).alias("type"), *[F.col(f"__e.{c}").alias(c) for c in ("text", "sources", "metrics")]]
    return kept.select(*[c for c in lines.columns if c != line], *event)


def lines(rows: DataFrame, *keep: str) -> DataFrame:
    """Events (type, text, sources, metrics) as the lines of a stream, in column value; the end mark as such."""
    event = F.to_json(F.struct("type", "text", "sources", "metrics"))
    return rows.select(*keep, F.concat(F.lit("data: "), F.when(F.col("type") == DONE, F.lit(DONE)).otherwise(event)).alias("value"))


def events_once(events: DataFrame) -> DataFrame:
    """Each event (req_id, seq) as it arrived first."""
    return events.groupBy("req_id", "seq").agg(F.min_by(F.struct("type", "text", "sources", "metrics", "emitted_at"), "arrived_at").alias("e"), F.min("arrived_at").alias("arrived_at")).select("req_id", "seq", "e.*", "arrived_at")


def answers(events: DataFrame) -> DataFrame:
    """req_id, answer, tokens, fallback, complete, search_ms, gen_s, total_s: an answer stream put together in order of seq, up to its end mark.

    Times come from the last event that has metrics. A stream without an end mark is incomplete, and all of it counts.
    """
    once = events_once(events)
    token = F.when(F.col("type") == "token", F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    end = F.min(F.when(F.col("type") == DONE, F.col("seq")))
    rows = once.groupBy("req_id").agg(
        F.sort_array(F.collect_list(token)).alias("t"), end.alias("stop"),
        F.min(F.when(F.col("type") == "fallback", F.col("seq"))).alias("fell"), F.max_by("metrics", F.when(F.col("metrics").isNotNull(), F.col("seq"))).alias("m"),
    )
    mine = F.filter("t", lambda x: F.col("stop").isNull() | (x["seq"] < F.col("stop")))
    return rows.select(
        "req_id", F.array_join(F.transform(mine, lambda x: x["text"]), "").alias("answer"), F.size(mine).alias("tokens"), (F.col("fell").isNotNull() & (F.col("stop").isNull() | (F.col("fell") < F.col("stop")))).alias("fallback"),
        F.col("stop").isNotNull().alias("complete"), T.seconds(F.col("m.search_time")).try_cast("int").alias("search_ms"), T.seconds(F.col("m.gen_time")).alias("gen_s"), T.seconds(F.col("m.total_time")).alias("total_s"),
    )


def source_scores(events: DataFrame) -> DataFrame:
    """req_id, filename, score (3 decimals): of the last event with sources, the last score of each file; null scores are 0, null names empty."""
    last = events_once(events).where("type = 'sources'").groupBy("req_id").agg(F.max_by("sources", F.when(F.col("sources").isNotNull(), F.col("seq"))).alias("s"))
    each = last.select("req_id", F.posexplode("s").alias("at", "x"))
    return each.groupBy("req_id", F.coalesce("x.filename", F.lit("")).alias("filename")).agg(F.round(F.coalesce(F.max_by("x.score", "at"), F.lit(0.0)), 3).alias("score"))
