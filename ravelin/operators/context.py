"""From ranked rows to a context: deduplication, numbering, citation, gates, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import rules
from ravelin.functions import text as T

LEAST_SCORE = -999.0
#: Rows are the same for a context if their first bytes are.
SAME_BYTES = 100
NO_SOURCE, NOT_COVERED, SMALL_TALK, ANSWER = "no_source", "not_covered", "small_talk", "answer"


def context_rows(results: DataFrame) -> DataFrame:
    """Results (query_id, rank, id, filename, text, score, rrf) that a context cites, each text once, numbered from 1 as source_no."""
    key = T.first_bytes(F.coalesce("text", F.lit("")), SAME_BYTES)
    kept = results.where(F.col("score") >= LEAST_SCORE).withColumn("n", F.row_number().over(W.partitionBy("query_id", key).orderBy("rank"))).where("n = 1").drop("n")
    return kept.withColumn("source_no", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def contexts(rows: DataFrame) -> DataFrame:
    """query_id, context, included, files, max_rrf."""
    entry = F.concat(F.lit('<source id="'), F.col("source_no").cast("string"), F.lit('" filename="'), F.coalesce("filename", F.lit("")), F.lit('">\n'), F.coalesce("text", F.lit("")), F.lit("\n</source>\n\n"))
    listed = F.sort_array(F.collect_list(F.struct("source_no", entry.alias("entry"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["entry"]), "").alias("context"), F.count(F.lit(1)).alias("included"), F.countDistinct(F.coalesce("filename", F.lit("")),).alias("files"), F.max("rrf").alias("max_rrf"))


def coherent(results: DataFrame, least: float) -> DataFrame:
    """query_id, coherent: whether any result reaches the least score."""
    return results.groupBy("query_id").agg(F.coalesce(F.bool_or(F.col("score") >= least), F.lit(False)).alias("coherent"))


def platforms(results: DataFrame, platforms: list[tuple[str, list[str]]] = rules.PLATFORMS) -> DataFrame:
    """query_id, platform: the one that most results mention, with regard to case; the first of the list among equals, null for none."""
    body = F.concat(F.coalesce("text", F.lit("")), F.coalesce("filename", F.lit("")))
    counts = results.groupBy("query_id").agg(*[F.count_if(T.contains_any(body, words, fold=False)).alias(name) for name, words in platforms])
    best = F.greatest(*[F.col(name) for name, _ in platforms])
    label = F.when(best == 0, F.lit(None).cast("string"))
    for name, _ in platforms:
        label = label.when(F.col(name) == best, F.lit(name))
    return counts.select("query_id", label.alias("platform"))


def decisions(queries: DataFrame, results: DataFrame, least: float, chat: bool = True, word_boundary: bool = False) -> DataFrame:
    """query_id, decision: small_talk (in a chat), no_source, not_covered or answer."""
    rows = context_rows(results).groupBy("query_id").agg(F.count(F.lit(1)).alias("included"))
    joined = queries.select("query_id", "q").join(rows, "query_id", "left").join(coherent(results, least), "query_id", "left")
    talk = T.is_small_talk(F.col("q"), word_boundary=word_boundary) if chat else F.lit(False)
    return joined.select("query_id", F.when(talk, SMALL_TALK).when(F.coalesce("included", F.lit(0)) == 0, NO_SOURCE).when(~F.coalesce("coherent", F.lit(False)), NOT_COVERED).otherwise(ANSWER).alias("decision"))


GUIDES = {
    "register": "List each bit with its exact name and meaning; mark a bit that the sources don't describe as undocumented.",
    "calculation": "Show every step with the formulas and values of the sources, and give units.",
    "code": "Explain with code taken from the sources, clearly laid out.",
}
GUIDE = "Give a structured, short answer from the sources."


def prompts(queries: DataFrame, context: DataFrame, platform: DataFrame) -> DataFrame:
    """query_id, prompt: instructions by kind of question, the cited sources and the question. Only questions about code name the platform."""
    kind = T.question_kind(F.col("q"))
    guide = F.lit(GUIDE)
    for name, text in GUIDES.items():
        guide = F.when(kind == name, F.lit(text)).otherwise(guide)
    hint = F.when((kind == "code") & F.col("platform").isNotNull(), F.concat(F.lit("\nPlatform: "), F.col("platform"))).otherwise("")
    joined = queries.select("query_id", "q").join(context.select("query_id", "context"), "query_id").join(platform, "query_id", "left")
    return joined.select("query_id", F.concat(F.lit("Answer from the sources only and name their files once, at the end.\n"), guide, hint, F.lit("\n\nSOURCES:\n"), "context", F.lit("\nQUESTION: "), "q", F.lit("\n")).alias("prompt"))


def source_events(rows: DataFrame) -> DataFrame:
    """query_id, source_no, filename, score, text: what an answer stream shows of its sources, 200 code points of each text."""
    return rows.select("query_id", "source_no", "filename", "score", F.left("text", F.lit(200)).alias("text"))
