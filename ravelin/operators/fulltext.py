"""Full-text search: prefix terms ranked by BM25, literal search, and the cascade of stages that a question runs through.

All questions are answered at once, from an index: postings (term, id, tf, dl) and sums over the corpus. A written index (build_index, append_index) is
sorted by term, so that the prefixes asked for prune row groups, and texts aren't touched at all. Without one the texts are scanned once: their tokens
meet the prefixes in a broadcast join inside the scan's stage, and only hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import rules
from ravelin.functions import text as T
from ravelin.runtime import pinned

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LIKE, ALL_TECHNICAL, ANY_TECHNICAL, ANY_VALID = range(4)
LIKE_SCORE = 0.8
#: Tokens are matched to prefixes by up to this many first signs, then by the whole prefix. A shorter prefix is a key of its own length.
KEY = 3
#: Up to so many prefixes are handed to the scan of a written index as well: more leave few row groups out, and each row would be compared with all.
PUSHED = 24


@dataclass(frozen=True)
class Index:
    """A written index: postings (term, id, tf, dl), a row for each term of a text, and sums (docs, tokens), any number of rows that add up."""

    postings: DataFrame
    sums: DataFrame


def query_terms(queries: DataFrame, stop: list[str] = rules.STOP_WORDS, technical: list[str] = rules.TECHNICAL_TERMS) -> DataFrame:
    """query_id, literal, technical, valid: what each stage of a question (q) looks for."""
    w = T.words(F.col("q"))
    literal = F.filter(F.transform(w, T.bare), lambda x: (F.char_length(x) >= 4) & x.rlike("[./-]"))
    clean = F.transform(w, lambda x: F.replace(F.replace(x, F.lit('"'), F.lit('""')), F.lit("'"), F.lit("")))
    valid = F.filter(clean, lambda x: (F.char_length(x) > 3) & ~F.array_contains(T.strings(stop), F.lower(x)))
    marked = F.filter(valid, lambda x: x.rlike("[A-Z0-9]"))
    known = F.filter(F.transform(w, T.bare), lambda x: (F.char_length(x) >= 3) & F.array_contains(T.strings([t.strip() for t in technical]), F.lower(x)))
    return queries.select("query_id", literal.alias("literal"), F.array_distinct(F.concat(marked, known)).alias("technical"), valid.alias("valid"))


def stages(terms: DataFrame, strict: bool = True) -> DataFrame:
    """query_id, stage, need, prefix: one row for each term of a stage that can run; need is how many distinct terms a text must match."""
    def stage(n: int, column: str, when: Column, all_: bool) -> DataFrame:
        return terms.where(when).select("query_id", F.lit(n).alias("stage"), F.lit(all_).alias("all_"), F.col(column).alias("terms"))

    some = stage(ALL_TECHNICAL, "technical", F.size("technical") > 1, True).unionByName(stage(ANY_TECHNICAL, "technical", F.size("technical") > 0, False)).unionByName(stage(ANY_VALID, "valid", F.size("valid") > 0, False))
    if strict:  # one term with a sign that the syntax doesn't allow makes the whole expression an error
        some = some.where(F.forall("terms", lambda t: t.rlike(r"^[A-Za-z0-9_\x{80}-\x{10FFFF}]+$") & ~t.isin("AND", "OR", "NOT")))
        prefixes = F.array_distinct(F.transform("terms", T.folded))
    else:
        prefixes = F.array_distinct(F.flatten(F.transform("terms", T.tokens)))
    listed = some.select("query_id", "stage", "all_", prefixes.alias("p"))
    return listed.select("query_id", "stage", F.when(F.col("all_"), F.size("p")).otherwise(1).alias("need"), F.explode("p").alias("prefix"))


def tokenised(chunks: DataFrame) -> DataFrame:
    """id, dl, terms."""
    return chunks.select("id", T.tokens(F.col("text")).alias("terms")).select("id", F.size("terms").alias("dl"), "terms")


def postings(chunks: DataFrame) -> DataFrame:
    """term, id, tf, dl: the inverted index as rows."""
    return tokenised(chunks).select("id", "dl", F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def sums(chunks: DataFrame) -> DataFrame:
    """docs, tokens: one row."""
    return tokenised(chunks).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens"))


def _write(chunks: DataFrame, path: str, partitions: int | None, mode: str) -> None:
    rows = postings(chunks)
    by_term = rows.repartitionByRange(partitions, "term") if partitions else rows.repartitionByRange("term")
    by_term.sortWithinPartitions("term", "id").write.mode(mode).parquet(f"{path}/postings")
    sums(chunks).coalesce(1).write.mode(mode).parquet(f"{path}/sums")


def build_index(chunks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes postings sorted by term and sums over the corpus. A prefix is a range of terms: row groups outside are never read."""
    _write(chunks, path, partitions, "overwrite")


def append_index(chunks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Adds the postings of new texts as a sorted run of their own; what's there stays as it is. build_index brings all runs together again."""
    _write(chunks, path, partitions, "append")


def open_index(spark, path: str) -> Index:  # noqa: ANN001
    return Index(spark.read.schema("term STRING, id STRING, tf BIGINT, dl INT").parquet(f"{path}/postings"), spark.read.schema("docs BIGINT, tokens BIGINT").parquet(f"{path}/sums"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """docs, avgdl: one row."""
    return _stats(sums(chunks))


def _stats(parts: DataFrame) -> DataFrame:
    return parts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.sum("tokens").alias("t")).select("docs", F.try_divide("t", "docs").alias("avgdl"))


def _met(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """rows (term, ...) with each prefix that their term starts with. Prefixes are broadcast: a bounded list."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(p, p[:KEY]) for p in prefixes], "prefix string, k string"))
    lengths = sorted({min(len(p), KEY) for p in prefixes})
    each = [F.left("term", F.lit(n)) for n in lengths]
    keyed = rows.withColumn("k", each[0] if len(each) == 1 else F.explode(F.array_distinct(F.array(*each))))
    return keyed.join(wanted, "k").where(F.col("term").startswith(F.col("prefix"))).drop("k", "term")


def indexed_hits(index: DataFrame, prefixes: list[str]) -> DataFrame:
    """prefix, id, tf, dl from written postings: by ranges of terms that the scan can prune."""
    prefixes = sorted(set(filter(None, prefixes)))
    if not prefixes:
        return index.limit(0).select(F.col("term").alias("prefix"), "id", "tf", "dl")
    least = [p for k, p in enumerate(prefixes) if not k or not p.startswith(tuple(prefixes[:k]))]
    rows = index.where(reduce(Column.__or__, [F.col("term").startswith(p) for p in least])) if len(least) <= PUSHED else index
    return _met(rows, prefixes).groupBy("prefix", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def prefix_hits(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, id, tf, dl: texts with tokens that start with a prefix, from the texts themselves. prefixes is a set of questions' terms: it's collected."""
    found = sorted({r["prefix"] for r in pinned(prefixes.select("prefix")).collect()} - {"", None})
    rows = tokenised(chunks).select("id", "dl", F.explode("terms").alias("term"))
    if not found:
        return rows.limit(0).select(F.col("term").alias("prefix"), "id", F.lit(0).cast("long").alias("tf"), "dl")
    return _met(rows, found).groupBy("prefix", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """prefix, id, part: what each prefix adds to a text's score. Prefixes are as few as the questions' terms; stats is one row."""
    n = hits.groupBy("prefix").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") > 0)).alias("n"))  # needs all columns, so that the hits' exchange is used again
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    weighed = F.broadcast(n.crossJoin(F.broadcast(stats)).select("prefix", idf.alias("idf"), "avgdl"))
    tf, length = F.col("tf"), 1 - B + B * F.col("dl") / F.col("avgdl")
    return hits.join(weighed, "prefix").select("prefix", "id", (F.col("idf") * tf * (K1 + 1) / (tf + K1 * length)).alias("part"))


def scored_stages(chunks: DataFrame, staged: DataFrame, index: Index | None = None) -> DataFrame:
    """query_id, stage, id, bm25 (6 decimals) of the texts that match each stage."""
    staged = pinned(staged)
    if index is None:
        parts = bm25(prefix_hits(chunks, staged), corpus_stats(chunks))
    else:
        parts = bm25(indexed_hits(index.postings, [r["prefix"] for r in staged.collect()]), _stats(index.sums))
    met = parts.join(F.broadcast(staged), "prefix").groupBy("query_id", "stage", "id").agg(F.sum("part").alias("s"), F.count(F.lit(1)).alias("met"), F.first("need").alias("need"))
    return met.where("met >= need").select("query_id", "stage", "id", F.round("s", 6).alias("bm25"))


def literal_hits(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, id: texts with all literal tokens of a question, without regard to case. Questions without such tokens have none.

    One automaton finds the tokens of all questions in a single pass over each text, so work goes with the texts and the hits, not with the questions.
    """
    rows = pinned(terms.where(F.size("literal") > 0).select("query_id", F.array_distinct(F.transform("literal", F.lower)).alias("literal"))).collect()
    kind, ident = terms.schema["query_id"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()
    if not rows:
        return chunks.sparkSession.createDataFrame([], f"query_id {kind}, id {ident}")
    numbers: dict[str, int] = {}
    asked: list[tuple[object, int, int]] = []
    for r in rows:
        asked += [(r["query_id"], numbers.setdefault(x, len(numbers)), len(r["literal"])) for x in r["literal"]]
    held = chunks.sparkSession.sparkContext.broadcast(numbers)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for x, n in held.value.items():
            auto.add_word(x, n)
        auto.make_automaton()
        for batch in batches:
            ids, which = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                there = {n for _, n in auto.iter(text)}
                ids += [k] * len(there)
                which += there
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(which, pa.int32())], ["id", "n"])

    texts = chunks.select("id", F.lower("text").alias("t")).where("t is not null and id is not null")
    hits = texts.mapInArrow(found, f"id {ident}, n int")
    wanted = F.broadcast(chunks.sparkSession.createDataFrame(asked, f"query_id {kind}, n int, need int"))  # pinned above
    return hits.join(wanted, "n").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")).where("met = need").select("query_id", "id")


def cascade(chunks: DataFrame, queries: DataFrame, limit: int, strict: bool = True, rank_order: str = "reference", stop: list[str] = rules.STOP_WORDS, technical: list[str] = rules.TECHNICAL_TERMS, own_limit: Column | None = None, index: Index | None = None) -> DataFrame:
    """query_id, id, stage, bm25, score, rank: up to limit hits of the first stage that finds any; own_limit may lower it by query_id.

    Literal hits all score 0.8, in the order of their identifiers. Of other hits the best by BM25 are taken, then ordered by 1 / (1 + BM25):
    the strongest come last, unless rank_order is "best_first".
    """
    terms = pinned(query_terms(queries, stop, technical))
    literal = literal_hits(chunks, terms).select("query_id", F.lit(LIKE).alias("stage"), "id", F.lit(None).cast("double").alias("bm25"))
    every = literal.unionByName(scored_stages(chunks, stages(terms, strict), index))
    by = W.partitionBy("query_id", "stage").orderBy(F.desc_nulls_last("bm25"), "id")
    top = every.withColumn("n", F.row_number().over(by)).where(F.col("n") <= limit)  # a constant, so that each map task keeps no more either
    top = top if own_limit is None else top.where(F.col("n") <= own_limit)
    first = top.withColumn("least", F.min("stage").over(W.partitionBy("query_id"))).where("stage = least")
    mapped = first.select("query_id", "id", "stage", "bm25", F.when(F.col("stage") == LIKE, F.lit(LIKE_SCORE)).when(F.col("bm25") > 0, F.round(1 / (1 + F.col("bm25")), 6)).otherwise(0.1).alias("score"))
    order = (F.desc("score"), "id") if rank_order == "reference" else (F.desc_nulls_last("bm25"), "id")
    return mapped.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def two_passes(chunks: DataFrame, queries: DataFrame, limit: int, **how: object) -> DataFrame:
    """query_id, id, pass, rank: the question's hits, then those of its expansion, whose ranks go on after the first pass's last.

    A text that both passes find is there twice. The second pass runs where the expansion isn't empty and isn't the question itself.
    """
    stop = list(how.get("stop", rules.STOP_WORDS))
    key = lambda n: F.struct("query_id", F.lit(n).alias("pass")).alias("query_id")
    wider = queries.select("query_id", "q", T.expanded_query(F.col("q"), stop).alias("x")).where("x <> '' and x <> q").select(key(2), F.col("x").alias("q"))
    both = queries.select(key(1), "q").unionByName(wider)  # one search for both, so that the corpus is scanned once
    hits = cascade(chunks, both, limit, own_limit=F.when(F.col("query_id.pass") == 1, limit).otherwise(limit // 2), **how)
    rows = hits.select("query_id.query_id", "id", "query_id.pass", "rank")
    before = F.coalesce(F.max(F.when(F.col("pass") == 1, F.col("rank"))).over(W.partitionBy("query_id")), F.lit(0))
    return rows.select("query_id", "id", "pass", F.when(F.col("pass") == 1, F.col("rank")).otherwise(F.col("rank") + before).cast("int").alias("rank"))
