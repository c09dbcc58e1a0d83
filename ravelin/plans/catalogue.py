"""All registered queries of the core and their SQL. Each runs over its whole tables; chunks that are delivered again count once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.config import Config
from ravelin.functions import rules
from ravelin.functions import text as T
from ravelin.functions import vectors as V
from ravelin.operators import chunking, context, dedup, evaluate, fulltext, fusion, mmr, rerank, vector
from ravelin.plans import engine
from ravelin.plans import sql as S
from ravelin.runtime import broadcast_if_small, passing, pinned, written
from ravelin.sources import events, files, store

Query = Callable[[SparkSession, str], DataFrame]
K = 8
CORE = ["datasheet", "manuel"]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there's any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks_of(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", *columns).dropDuplicates(["id"])


_stores: dict[tuple, store.ChunkStore] = {}


def stored(spark: SparkSession, sf: str) -> store.ChunkStore:
    """All chunks in a store with its full-text index, filled when a session first asks for these tables and kept as long, as a store is.

    The file's time and size are part of its name, so a table that changes is stored anew.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/chunks.parquet")
    s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    key = (spark.sparkContext.applicationId, sf, s.getModificationTime(), s.getLen())
    if key not in _stores:
        made = store.ChunkStore(spark, passing(spark, "store"))
        made.insert(table(spark, sf, "chunks"))
        _stores[key] = made
    return _stores[key]


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, q, question."""
    return table(spark, sf, "test_cases").select(F.col("test_id").alias("query_id"), T.normal_query(F.col("question")).alias("q"), "question")


def with_vectors(spark: SparkSession, sf: str, questions: DataFrame) -> DataFrame:
    """Questions with a vector each: no model is at hand, so those of the first 48 chunks stand in for their embeddings."""
    first = chunks_of(spark, sf, "embedding").where("embedding is not null").orderBy("id").limit(48)
    numbered = first.select(F.row_number().over(W.orderBy("id")).alias("query_id"), F.col("embedding").alias("qvec"))  # 48 rows
    return pinned(questions.join(F.broadcast(numbered), "query_id", "left"))


# Stores and files


@query(f"WITH {S.CHUNK} SELECT count(*) AS chunks, count(embedding) AS with_vector, count(DISTINCT filename) AS files, coalesce(max(len(embedding)), 0) AS vec_dim FROM chunk")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.stats(chunks_of(spark, sf, "filename", "embedding"))


@query("SELECT DISTINCT filename FROM chunks ORDER BY filename")
def distinct_files(spark: SparkSession, sf: str) -> DataFrame:
    return store.files(table(spark, sf, "chunks"))


@query(f"SELECT DISTINCT id FROM chunks WHERE NOT list_contains({S.listed(rules.IGNORED_EXTENSIONS)}, lower(regexp_extract(filename, '\\.[^./]*$'))) AND NOT starts_with(filename, '.') AND NOT starts_with(filename, '~$') AND NOT {S.any_of('filename', ['wiring'])} AND strlen({S.white('text')}) >= 50")
def gate_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that would pass the gate of files: by name, ignored patterns and length in bytes."""
    return table(spark, sf, "chunks").where(files.wanted_name(F.col("filename"), ["wiring"]) & files.enough_text(F.col("text"))).select("id").distinct()


@query(f"SELECT doc_id, {S.normal_lines('text')} AS text FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normal_lines(F.col("text")).alias("text"))


PARAGRAPHS = rf"para AS (SELECT doc_id, unnest(ps) AS para, unnest(range(len(ps))) AS par_no FROM (SELECT doc_id, list_filter(list_transform(string_split({S.normal_lines('text')}, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL))"


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("par_no", "para"))


@query(f"WITH {PARAGRAPHS} SELECT doc_id, par_no, para FROM para")
def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    return _paragraphs(spark, sf)


@query(rf"""WITH {PARAGRAPHS}, lines AS (SELECT *, regexp_extract({S.white('para')}, '^[^\n]*') AS line FROM para)
SELECT doc_id, par_no, starts_with(para, '#') OR starts_with(para, '==') OR starts_with(para, '--') OR (length(line) < 80 AND line <> '' AND
  ((regexp_matches(line, '^\d') AND regexp_matches(regexp_replace(line, '^[0-9.]+[{S.SP}]*', ''), '^\p{{Lu}}')) OR (line = upper(line) AND length(line) > 5 AND contains(line, ' ')))) AS section,
  starts_with(para, '```') OR starts_with(para, '~~~') AS code FROM lines""")
def section_detect(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("para")
    return _paragraphs(spark, sf).select("doc_id", "par_no", T.is_section(p).alias("section"), T.is_code_block(p).alias("code"))


@query(rf"SELECT doc_id, CASE WHEN length(text) <= 150 THEN text ELSE {S.white(r"regexp_extract(right(text, 150), '(?s)^.*[.!?](.+)$', 1)")} END AS tail FROM documents")
def tail_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.tail_sentence(F.col("text")).alias("tail"))


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Section-aware chunks of all documents, with deterministic identifiers."""
    cut = chunking.chunked(table(spark, sf, "documents").withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.col("doc_id"))), "path", "text")
    return cut.select(T.chunk_id(F.col("path"), F.col("chunk_ord").cast("string"), F.col("text")).alias("id"), "path", "chunk_ord", "text")


@query(f"WITH {S.CHUNK} SELECT id FROM chunk QUALIFY row_number() OVER (PARTITION BY coalesce({S.first_bytes('lower(' + S.collapsed('text') + ')', 400)}, ''), lower(filename) ORDER BY id) = 1")
def exact_prefix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of chunks of one file name whose first 400 bytes agree, the first."""
    return dedup.without_copies(chunks_of(spark, sf, "text", "filename"), [F.col("id")]).select("id")


@query(f"WITH {S.CHUNK} SELECT id FROM chunk QUALIFY row_number() OVER (PARTITION BY filename ORDER BY id) <= 50 OR coalesce({S.any_of('filename', CORE)}, false)")
def per_file_cap(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.capped_per_file(chunks_of(spark, sf, "filename"), "filename", [F.col("id")], 50, CORE).select("id")


@query(f"WITH {S.CHUNK} SELECT id, sha256(filename || chr(0) || text) AS chunk_id FROM chunk WHERE filename IS NOT NULL AND text IS NOT NULL")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_of(spark, sf, "text", "filename").where("filename is not null and text is not null").select("id", T.chunk_id(F.col("filename"), F.col("text")).alias("chunk_id"))


@query(f"WITH {S.CHUNK} SELECT id, {S.case_of('filename', rules.DOMAINS, '')} AS domain FROM chunk")
def domain_tag(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_of(spark, sf, "filename").select("id", T.domain(F.col("filename")).alias("domain"))


@query(f"WITH {S.CHUNK}, {S.CORPUS} SELECT (SELECT count(*) FROM chunk) AS chunks, (SELECT count(embedding) FROM chunk) AS with_vector, (SELECT count(*) FROM (SELECT DISTINCT term, id FROM post)) AS postings, (SELECT count(*) FROM post)::BIGINT AS tokens, (SELECT count(*) FROM chunk) AS added, 0 AS again")
def store_insert(spark: SparkSession, sf: str) -> DataFrame:
    """What a store holds after chunks without vectors, all chunks with theirs, and all chunks once more: inserts skip and refill."""
    rows = table(spark, sf, "chunks")
    s = store.ChunkStore(spark, passing(spark, "inserted"))
    bare = rows.where("id < '8'").withColumn("embedding", F.lit(None).cast("array<float>"))
    added = s.insert(bare)["added"] + s.insert(rows)["added"]
    again = s.insert(rows)["added"]
    s.compact()
    index = s.text_index()
    held = s.stats().select("chunks", "with_vector").crossJoin(index.postings.agg(F.count(F.lit(1)).alias("postings"))).crossJoin(index.sums.agg(F.sum("tokens").alias("tokens")))  # one row each
    return held.withColumns({"added": F.lit(added).cast("long"), "again": F.lit(again)})


# Questions


def _question(name: str, sql: str, column: Callable[[F.Column], F.Column]) -> None:
    """A query with one derived column over all questions."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "test_cases").select("test_id", column(F.col("question")).alias("result"))

    QUERIES[name] = run
    SQL[name] = f"SELECT test_id, {sql} AS result FROM test_cases"


_question("normalize_query", S.normal_query("question"), T.normal_query)
_question("classify_question", S.case_of("question", rules.QUESTION_KINDS, "general"), T.question_kind)
_question("small_talk", S.any_of("question", rules.SMALL_TALK), T.is_small_talk)
_question("technical_query", S.any_of("question", rules.TECHNICAL_TERMS), T.is_technical)
_question("strip_stopwords", S.without_stop_words("question"), T.without_stop_words)
_question("expand_query", S.expanded("question"), T.expanded_query)


@query(f"SELECT test_id, w.word FROM test_cases, unnest({S.words('question')}) w(word) WHERE NOT list_contains({S.listed(rules.STOP_WORDS)}, lower({S.bare('w.word')}))")
def stopword_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Words of questions that aren't stop words, as a join."""
    each = table(spark, sf, "test_cases").select("test_id", F.explode(T.words(F.col("question"))).alias("word"))
    stop = spark.createDataFrame([(w,) for w in rules.STOP_WORDS], "stop string")
    return each.join(F.broadcast(stop), F.lower(T.bare(F.col("word"))) == F.col("stop"), "left_anti")


@query(f"SELECT run_id, model, {S.any_of('model', rules.LARGE_MODELS)} AS large FROM (SELECT DISTINCT run_id, model FROM run_results)")
def large_model(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "run_results").select("run_id", "model").distinct().select("run_id", "model", T.is_large_model(F.col("model")).alias("large"))


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.terms('one', 'asked')} SELECT query_id, list_sort(literal) AS literal, list_sort(technical) AS technical, list_sort(valid) AS valid FROM one_t")
def fts_terms(spark: SparkSession, sf: str) -> DataFrame:
    """What each stage of full-text search looks for."""
    return fulltext.query_terms(asked(spark, sf)).select("query_id", *[F.array_sort(c).alias(c) for c in ("literal", "technical", "valid")])


# Retrieval


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.terms('one', 'asked')} SELECT query_id, id FROM one_t, chunk WHERE len(literal) > 0 AND text IS NOT NULL AND len(list_filter(literal, lambda x: NOT contains(lower(text), lower(x)))) = 0")
def like_search(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.literal_hits(chunks_of(spark, sf, "text"), fulltext.query_terms(asked(spark, sf)))


def _scored(stage: int) -> tuple[Query, str]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        staged = fulltext.stages(fulltext.query_terms(asked(spark, sf))).where(F.col("stage") == stage)
        return fulltext.scored_stages(chunks_of(spark, sf, "text"), staged).select("query_id", "id", "bm25")

    return run, f"WITH {S.CHUNK}, {S.ASKED}, {S.CORPUS}, {S.terms('one', 'asked')}, {S.scored('one')} SELECT query_id, id, bm25 FROM one_m WHERE stage = {stage}"


for _name, _stage in (("bm25_and", fulltext.ALL_TECHNICAL), ("bm25_or", fulltext.ANY_TECHNICAL), ("bm25_any_word", fulltext.ANY_VALID)):
    QUERIES[_name], SQL[_name] = _scored(_stage)


OWN = r"own AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id)::INT AS query_id, array_to_string(names[1:2], ' ') AS q FROM (SELECT id, regexp_extract_all(text, '[A-Z][A-Za-z0-9]{4,}') AS names FROM chunk) WHERE len(names) > 1 ORDER BY id LIMIT 48)"


@query(f"WITH {S.CHUNK}, {OWN}, {S.CORPUS}, {S.terms('one', 'own')}, {S.scored('one')} SELECT query_id, id, bm25 FROM one_m WHERE stage = {fulltext.ALL_TECHNICAL}")
def bm25_all_names(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with both of the first two names of a text, for 48 texts: questions that the strictest stage answers."""
    names = F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z0-9]{4,}"), F.lit(0))
    first = chunks_of(spark, sf, "text").select("id", names.alias("names")).where("size(names) > 1").orderBy("id").limit(48)
    own = pinned(first.select(F.row_number().over(W.orderBy("id")).alias("query_id"), F.array_join(F.slice("names", 1, 2), " ").alias("q")))
    staged = fulltext.stages(fulltext.query_terms(own)).where(F.col("stage") == fulltext.ALL_TECHNICAL)
    return fulltext.scored_stages(chunks_of(spark, sf, "text"), staged).select("query_id", "id", "bm25")


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.CORPUS} SELECT docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM post) AS tokens, (SELECT count(DISTINCT term) FROM post) AS terms FROM stats")
def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    tok = fulltext.tokenised(chunks_of(spark, sf, "text"))
    terms = tok.select(F.explode("terms").alias("term")).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("term").alias("terms"))
    return tok.agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("dl") / F.count(F.lit(1)), 6).alias("avgdl")).crossJoin(terms)  # one row each


@query(f"WITH {S.CHUNK}, {S.CORPUS} SELECT term, count(DISTINCT id) AS docs, count(*) AS occurrences FROM post GROUP BY term")
def term_index(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index by term."""
    return fulltext.postings(chunks_of(spark, sf, "text")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.CORPUS}, {S.cascade('one', 'asked', S.FETCH)} SELECT query_id, id, stage, bm25, score, rank FROM one_hits")
def fts_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """From the written index."""
    held = stored(spark, sf)
    return fulltext.cascade(held.chunks(), asked(spark, sf), S.FETCH, index=held.text_index())


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.CORPUS}, {S.cascade('one', 'asked', S.FETCH)} SELECT query_id, id, stage, bm25, score, rank FROM one_hits")
def fts_cascade_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the texts alone, without an index."""
    return fulltext.cascade(chunks_of(spark, sf, "text"), asked(spark, sf), S.FETCH)


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.CORPUS}, {S.PASSES} SELECT query_id, id, pass, rank FROM passes")
def two_pass_fts(spark: SparkSession, sf: str) -> DataFrame:
    held = stored(spark, sf)
    return fulltext.two_passes(held.chunks(), asked(spark, sf), S.FETCH, index=held.text_index())


@query(f"WITH {S.CHUNK}, {S.ASKED}, {S.NEAR} SELECT query_id, id, cosine, rank FROM near")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector.topk(chunks_of(spark, sf, "embedding"), with_vectors(spark, sf, asked(spark, sf)), S.FETCH)


@query("SELECT count(*) AS questions, true AS enough FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Search in written cells against the exact one: all vectors are indexed, those whose number is divisible by 50 are the questions, and at least
    nine tenths of their ten nearest must be found."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = passing(spark, "cells")
    vector.build_cells(e, path)
    q = pinned(e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec")))
    exact, found = vector.topk(e, q, 10), vector.indexed_topk(vector.open_cells(spark, path, e.schema["id"].dataType.simpleString()), q, 10)
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("questions"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector with the next, as a column expression."""
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", "other", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query(f"WITH {S.CHUNK}, {S.ASKED} SELECT a.query_id, list_transform(list_zip(a.qvec, b.qvec), lambda x: round((x[1]::DOUBLE + x[2]::DOUBLE) / 2, 5)) AS qvec FROM vec a JOIN vec b ON b.query_id = a.query_id + 1")
def vector_mean_query(spark: SparkSession, sf: str) -> DataFrame:
    """Means of two vectors of a question, as two embeddings of it are merged."""
    v = with_vectors(spark, sf, asked(spark, sf)).where("qvec is not null").select("query_id", "qvec")
    other = v.select((F.col("query_id") - 1).alias("query_id"), F.col("qvec").alias("b"))
    return v.join(F.broadcast(other), "query_id").select("query_id", F.transform(V.mean(F.col("qvec"), F.col("b")), lambda x: F.round(x.cast("double"), 5)).alias("qvec"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    held, q = stored(spark, sf), with_vectors(spark, sf, asked(spark, sf))
    c = held.chunks()
    kinds = q.select("query_id", T.is_technical(F.col("q")).alias("technical"))
    return fusion.fused(vector.topk(c, q, S.FETCH), fulltext.two_passes(c, q, S.FETCH, index=held.text_index()), kinds)


@query(f"{S.HYBRID} SELECT query_id, id, rrf, score FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of both kinds of hits with normalised scores."""
    return _fused(spark, sf)


@query(f"{S.HYBRID} SELECT query_id, id, rrf, score FROM fused JOIN kinds USING (query_id) WHERE technical")
def rrf_technical(spark: SparkSession, sf: str) -> DataFrame:
    """The same for technical questions, which full text alone answers."""
    technical = asked(spark, sf).where(T.is_technical(F.col("q"))).select("query_id")
    return _fused(spark, sf).join(F.broadcast(technical), "query_id", "left_semi")


@query(f"{S.HYBRID} SELECT query_id, id, rrf, score, place FROM pool")
def rerank_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf)


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    held = stored(spark, sf)
    return engine.candidates(held.chunks(), with_vectors(spark, sf, asked(spark, sf)), K, index=held.text_index())


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Results in the order of fusion, as they are without re-ranking and diversification."""
    found = written(_pool(spark, sf), "found")
    return stored(spark, sf).chunks().join(broadcast_if_small(found), "id").select("query_id", F.col("place").alias("rank"), "id", "filename", "text", "score", "rrf")


@query(f"{S.HYBRID} SELECT query_id, rank, id, filename, score, rrf FROM results")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: full-text and vector search fused, for all questions at once."""
    return _results(spark, sf).drop("text")


@query()
def hybrid_answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search, with a stand-in re-ranker left out and diversification."""
    held = stored(spark, sf)
    return engine.search(held.chunks(), with_vectors(spark, sf, asked(spark, sf)), K, index=held.text_index()).drop("text")


@query()
def mmr_diversify(spark: SparkSession, sf: str) -> DataFrame:
    """Diversification alone, over the pool."""
    found = written(_pool(spark, sf), "found")
    rows = stored(spark, sf).chunks().drop("text").join(broadcast_if_small(found), "id").withColumn("has_vector", F.lit(True))
    return mmr.diversified(rows, K).select("query_id", "rank", "id", "filename", "score")


LEXICAL = f"round(CASE WHEN len(a) > 0 THEN 4.0 * len(list_intersect(a, {S.tokens('text')})) / len(a) ELSE 0.0 END - 2, 6)"


@query(f"""{S.HYBRID}, lex AS (SELECT query_id, id, {LEXICAL} AS rerank_score FROM results JOIN (SELECT query_id, list_distinct({S.tokens('q')}) AS a FROM asked) USING (query_id)),
ends AS (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best, min(rerank_score) OVER (PARTITION BY query_id) AS worst FROM lex)
SELECT query_id, id, rerank_score, round(CASE WHEN best - worst > 1e-4 THEN (rerank_score - worst) / (best - worst) * CASE WHEN best < -2 THEN 0.5 ELSE 1.0 END ELSE 0.5 * CASE WHEN best < -2 THEN 0.5 ELSE 1.0 END END, 6) AS score FROM ends""")
def minmax_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Re-ranking by a stand-in score, rescaled."""
    rows = _results(spark, sf).drop("score").join(F.broadcast(asked(spark, sf).select("query_id", "q")), "query_id")
    return fusion.rescaled(rows.withColumn("rerank_score", rerank.lexical_score(F.col("q"), F.col("text")))).select("query_id", "id", "rerank_score", "score")


# Contexts and answers

CITED = f"cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_no FROM (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY query_id, {S.first_bytes("coalesce(text, '')", 100)} ORDER BY rank) = 1))"
COUNTS = ", ".join(f"count(*) FILTER ({S.any_of("coalesce(text, '') || coalesce(filename, '')", ws, fold=False)}) AS {n}" for n, ws in rules.PLATFORMS)
BEST = f"greatest({', '.join(n for n, _ in rules.PLATFORMS)})"


@query(f"""{S.HYBRID}, {CITED} SELECT query_id, string_agg('<source id="' || source_no || '" filename="' || coalesce(filename, '') || '">' || chr(10) || coalesce(text, '') || chr(10) || '</source>' || chr(10) || chr(10), '' ORDER BY source_no) AS context,
count(*) AS included, count(DISTINCT coalesce(filename, '')) AS files, max(rrf) AS max_rrf FROM cited GROUP BY query_id""")
def context_build(spark: SparkSession, sf: str) -> DataFrame:
    return context.contexts(context.context_rows(_results(spark, sf)))


@query(f"{S.HYBRID}, {CITED} SELECT query_id, source_no, filename, score, left(text, 200) AS text FROM cited")
def source_events(spark: SparkSession, sf: str) -> DataFrame:
    return context.source_events(context.context_rows(_results(spark, sf)))


@query(f"{S.HYBRID} SELECT query_id, bool_or(score >= 0.3) AS coherent FROM results GROUP BY query_id")
def coherence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return context.coherent(_results(spark, sf), Config().retrieval.min_score)


@query(f"{S.HYBRID}, votes AS (SELECT query_id, {COUNTS} FROM results GROUP BY query_id) SELECT query_id, CASE WHEN {BEST} = 0 THEN NULL {' '.join(f"WHEN {n} = {BEST} THEN '{n}'" for n, _ in rules.PLATFORMS)} END AS platform FROM votes")
def platform_vote(spark: SparkSession, sf: str) -> DataFrame:
    return context.platforms(_results(spark, sf))


@query(f"""{S.HYBRID} SELECT query_id, CASE WHEN {S.any_of('q', rules.SMALL_TALK)} THEN 'small_talk' WHEN coalesce(n, 0) = 0 THEN 'no_source' WHEN NOT coalesce(ok, false) THEN 'not_covered' ELSE 'answer' END AS decision
FROM asked LEFT JOIN (SELECT query_id, count(*) AS n, bool_or(score >= 0.3) AS ok FROM results GROUP BY query_id) USING (query_id)""")
def answer_gate(spark: SparkSession, sf: str) -> DataFrame:
    return context.decisions(asked(spark, sf), _results(spark, sf), Config().retrieval.min_score)


VOTED = f"votes AS (SELECT query_id, {COUNTS} FROM results GROUP BY query_id), voted AS (SELECT query_id, CASE WHEN {BEST} = 0 THEN NULL {' '.join(f"WHEN {n} = {BEST} THEN '{n}'" for n, _ in rules.PLATFORMS)} END AS platform FROM votes)"
KIND = S.case_of("q", rules.QUESTION_KINDS, "general")
GUIDES = " ".join(f"WHEN '{k}' THEN {S.quoted(v)}" for k, v in context.GUIDES.items())


@query(f"""{S.HYBRID}, {CITED}, {VOTED}, body AS (SELECT query_id, string_agg('<source id="' || source_no || '" filename="' || coalesce(filename, '') || '">' || chr(10) || coalesce(text, '') || chr(10) || '</source>' || chr(10) || chr(10), '' ORDER BY source_no) AS context FROM cited GROUP BY query_id)
SELECT query_id, 'Answer from the sources only and name their files once, at the end.' || chr(10) || CASE {KIND} {GUIDES} ELSE {S.quoted(context.GUIDE)} END || CASE WHEN {KIND} = 'code' AND platform IS NOT NULL THEN chr(10) || 'Platform: ' || platform ELSE '' END
  || chr(10) || chr(10) || 'SOURCES:' || chr(10) || context || chr(10) || 'QUESTION: ' || q || chr(10) AS prompt FROM asked JOIN body USING (query_id) LEFT JOIN voted USING (query_id)""")
def answer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each question that has results."""
    found = _results(spark, sf)
    return context.prompts(asked(spark, sf), context.contexts(context.context_rows(found)), context.platforms(found))


# Evaluation

CASES = f"wanted AS (SELECT test_id, coalesce(type, 'normal') AS kind, coalesce(keywords, []) AS keywords, coalesce(sources, []) AS expected, coalesce(refusal_patterns, {S.listed(rules.REFUSALS)}) AS patterns FROM test_cases)"
GRADES = f"""{S.RUN}, {CASES}, joined AS (SELECT run_id, model, test_id, coalesce(result.error, '') <> '' AS error, coalesce(result.fallback, false) AS fallback, lower(coalesce(result.answer, '')) AS answer,
  coalesce(result.sources, []) AS names, kind, keywords, expected, patterns FROM run JOIN wanted USING (test_id)),
found AS (SELECT *, list_filter(keywords, lambda k: contains(answer, lower(k))) AS k, list_filter(expected, lambda e: len(list_filter(names, lambda n: contains(lower(n), lower(e)))) > 0) AS s, kind = 'trap' AS trap FROM joined),
grades AS (SELECT *, CASE WHEN error THEN 'ERROR' WHEN trap THEN CASE WHEN fallback OR len(list_filter(patterns, lambda p: contains(answer, lower(p)))) > 0 THEN 'PASS' ELSE 'FAIL' END
  WHEN (len(k) > 0 OR len(keywords) = 0) AND (len(s) > 0 OR len(expected) = 0) THEN 'PASS' WHEN len(k) > 0 OR len(keywords) = 0 OR len(s) > 0 OR len(expected) = 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM found)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.runs_once(table(spark, sf, "run_results"))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.graded(_runs(spark, sf), table(spark, sf, "test_cases"))


@query(f"WITH {GRADES} SELECT run_id, model, test_id, status, CASE WHEN error OR trap THEN [] ELSE k END AS keyword_found, CASE WHEN error OR trap THEN [] ELSE s END AS source_found FROM grades")
def eval_status(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf).select("run_id", "model", "test_id", "status", "keyword_found", "source_found")


@query(f"WITH {GRADES} SELECT run_id, CASE WHEN error OR trap THEN [] ELSE list_filter(keywords, lambda x: NOT list_contains(k, x)) END AS keyword_missing, CASE WHEN error OR trap THEN [] ELSE list_filter(expected, lambda x: NOT list_contains(s, x)) END AS source_missing FROM grades")
def missing_expected(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf).select("run_id", "keyword_missing", "source_missing")


@query(f"WITH {S.RUN}, f AS (SELECT run_id, test_id, unnest(result.sources) AS filename FROM run), e AS (SELECT test_id, unnest(sources) AS expected FROM test_cases) SELECT DISTINCT run_id, expected, filename FROM f JOIN e USING (test_id) WHERE contains(lower(filename), lower(expected))")
def source_matches(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.source_matches(_runs(spark, sf), table(spark, sf, "test_cases"))


@query(f"""WITH {S.RUN} SELECT model, count(*) AS tests, count(*) FILTER (eval.status = 'PASS') AS pass, count(*) FILTER (eval.status = 'PARTIAL') AS partial, count(*) FILTER (eval.status = 'FAIL') AS fail, count(*) FILTER (eval.status = 'ERROR') AS error,
round(count(*) FILTER (eval.status = 'PASS') / count(*) * 100, 1) AS pass_pct, round(avg(result.total_s), 3) AS mean_s, count(*) FILTER (test_type = 'trap' AND eval.status = 'PASS') AS traps_ok, count(*) FILTER (test_type = 'trap') AS traps, count(*) FILTER (result.fallback) AS fallbacks FROM run GROUP BY model""")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary(_runs(spark, sf))


@query(f"""WITH {S.RUN}, m AS (SELECT model, category, avg(result.total_s) AS m FROM run GROUP BY ALL), g AS (SELECT DISTINCT a.model, b.category FROM run a, (SELECT DISTINCT category FROM run) b),
r AS (SELECT g.model, g.category, round(coalesce(m, 0), 1) AS mean_s FROM g LEFT JOIN m ON g.model IS NOT DISTINCT FROM m.model AND g.category IS NOT DISTINCT FROM m.category)
SELECT *, (SELECT CASE WHEN max(mean_s) > 0 THEN max(mean_s) ELSE 1.0 END FROM r) AS most FROM r""")
def latency_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.latency(_runs(spark, sf))


MODELS = ["orvane-7b", "quilon-mini", "telmar-14b"]


@query(f"WITH {S.RUN} SELECT category, " + ", ".join(f"round(coalesce(avg(result.total_s) FILTER (model = '{m}'), 0), 1) AS \"{m}\"" for m in MODELS) + " FROM run GROUP BY category")
def latency_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = evaluate.pivoted(_runs(spark, sf), ["category"], MODELS, F.avg("result.total_s"))
    return wide.select("category", *[F.round(F.coalesce(F.col(f"`{m}`"), F.lit(0.0)), 1).alias(m) for m in MODELS])


@query(f"""WITH {S.RUN}, s AS (SELECT category, model, unnest(map_values(result.source_scores)) AS score FROM run), a AS (SELECT category, model, round(avg(score), 3) AS mean_score FROM s GROUP BY ALL)
SELECT *, CASE WHEN isnan(mean_score) THEN 'none' WHEN mean_score >= 0.7 THEN 'good' WHEN mean_score >= 0.4 THEN 'fair' WHEN mean_score > 0 THEN 'poor' ELSE 'none' END AS bucket FROM a""")
def score_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.source_scores(_runs(spark, sf))


@query(f"""WITH {S.RUN}, l AS (SELECT test_id, model, eval.status AS s, result.question AS q FROM run QUALIFY row_number() OVER (PARTITION BY test_id, model ORDER BY finished_at DESC, run_id DESC) = 1)
SELECT test_id, CASE WHEN length(min(q)) > 58 THEN left(min(q), 58) || '…' ELSE min(q) END AS question, """ + ", ".join(f"coalesce(max(s) FILTER (model = '{m}'), '—') AS \"{m}\"" for m in MODELS) + " FROM l GROUP BY test_id")
def status_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.status_matrix(_runs(spark, sf), MODELS)


@query(f"""WITH {S.RUN}, r AS (SELECT run_id, model, row_number() OVER w AS done, sum(coalesce(result.total_s, 0)::DECIMAL(18,6)) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE / row_number() OVER w AS m, count(*) OVER (PARTITION BY model) AS n FROM run WINDOW w AS (PARTITION BY model ORDER BY finished_at, run_id))
SELECT run_id, model, done, round(m, 3) AS mean_s, round(m * (n - done), 3) AS left_s FROM r""")
def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.running_mean(_runs(spark, sf))


@query(f"WITH {S.RUN} SELECT run_id, CASE WHEN length(result.answer) > 400 THEN left(result.answer, 400) || '…' ELSE result.answer END AS answer FROM run")
def display_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("run_id", T.clipped(F.col("result.answer"), 400).alias("answer"))


@query("SELECT DISTINCT id, CASE WHEN isnan(score) THEN 'none' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.4 THEN 'fair' WHEN score > 0 THEN 'poor' ELSE 'none' END AS bucket FROM chunks")
def score_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", T.score_bucket(F.col("score")).alias("bucket")).distinct()


# Answer streams


def _seconds(x: str) -> str:
    return rf"coalesce(try_cast(regexp_replace(trim(replace({x}, ',', '.'), ' '), '\s*m?s$', '') AS DOUBLE), 0)"


@query(f"""WITH {S.EVENT}, stop AS (SELECT req_id, min(seq) FILTER (type = '[DONE]') AS stop FROM event GROUP BY req_id), e AS (SELECT event.*, stop, stop IS NULL OR seq < stop AS before FROM event JOIN stop USING (req_id)),
g AS (SELECT req_id, coalesce(string_agg(coalesce(text, ''), '' ORDER BY seq) FILTER (type = 'token' AND before), '') AS answer, count(*) FILTER (type = 'token' AND before)::INT AS tokens, coalesce(min(seq) FILTER (type = 'fallback') < min(coalesce(stop, 2147483647)), false) AS fallback,
  bool_or(stop IS NOT NULL) AS complete, arg_max(metrics, seq) FILTER (metrics IS NOT NULL) AS m FROM e GROUP BY req_id)
SELECT req_id, answer, tokens, fallback, complete, {_seconds('m.search_time')}::INT AS search_ms, {_seconds('m.gen_time')} AS gen_s, {_seconds('m.total_time')} AS total_s FROM g""")
def token_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Answers put together from their streams, with times."""
    return events.answers(table(spark, sf, "sse_events"))


@query(f"""WITH {S.EVENT}, l AS (SELECT req_id, arg_max(sources, seq) FILTER (sources IS NOT NULL) AS s FROM event WHERE type = 'sources' GROUP BY req_id),
u AS (SELECT req_id, unnest(s) AS x, unnest(range(len(s))) AS place FROM l), n AS (SELECT req_id, coalesce(x.filename, '') AS filename, x.score AS score, place FROM u)
SELECT req_id, filename, round(coalesce(score, 0), 3) AS score FROM n QUALIFY row_number() OVER (PARTITION BY req_id, filename ORDER BY place DESC) = 1""")
def stream_source_scores(spark: SparkSession, sf: str) -> DataFrame:
    return events.source_scores(table(spark, sf, "sse_events"))


@query(f"WITH {S.EVENT} SELECT type, count(*) AS events, count(DISTINCT req_id) AS requests FROM event GROUP BY type")
def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events by type, from captured lines: rows are written as lines and parsed back."""
    once = events.events_once(table(spark, sf, "sse_events"))
    return events.parsed(events.lines(once, "req_id")).groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("req_id").alias("requests"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
