"""Streams: files into a store as they come, answer streams put together as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.plans.engine import HybridEngine
from ravelin.sources import events, files


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files below a folder, as they appear."""
    return spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("recursiveFileLookup", "true").load(root)


def index_stream(engine: HybridEngine, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Indexes files as they appear. Identifiers are deterministic and inserts skip what's there, so a batch that's repeated changes nothing."""
    spark, settings = engine.store.spark, engine.config.retrieval

    def batch(rows: DataFrame, _: int) -> None:
        engine.insert(files.file_chunks(files._filtered(rows.select("path", "content"), spark, root, settings), settings))

    writer = file_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def answer_stream(arriving: DataFrame, late: str = "10 minutes") -> DataFrame:
    """req_id, started, answer, tokens, complete of a stream of events (req_id, seq, type, text, emitted_at).

    Events that come again are dropped and late ones waited for, as far as the watermark allows; state goes with it. A request is over when
    nothing came for as long.
    """
    marked = arriving.withWatermark("emitted_at", late).dropDuplicatesWithinWatermark(["req_id", "seq"])
    token = F.when(F.col("type") == "token", F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    rows = marked.groupBy(F.session_window("emitted_at", late).alias("w"), "req_id").agg(F.sort_array(F.collect_list(token)).alias("t"), F.max((F.col("type") == events.DONE).cast("int")).alias("done"))
    return rows.select("req_id", F.col("w.start").alias("started"), F.array_join(F.transform("t", lambda x: x["text"]), "").alias("answer"), F.size("t").alias("tokens"), (F.col("done") == 1).alias("complete"))
