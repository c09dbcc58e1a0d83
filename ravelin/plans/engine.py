"""The hybrid engine: index files, search and answer many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.config import Config
from ravelin.functions import rules
from ravelin.functions import text as T
from ravelin.functions import vectors as V
from ravelin.operators import context, fulltext, fusion, mmr, rerank, vector
from ravelin.runtime import broadcast_if_small, pinned, written
from ravelin.sources import files
from ravelin.sources.store import ChunkStore


def candidates(chunks: DataFrame, queries: DataFrame, k: int, config: Config = Config(), index: fulltext.Index | None = None, cells: vector.Cells | None = None) -> DataFrame:
    """query_id, id, rrf, score, place: the pool of each question (query_id, q, qvec) after fusion. Without indexes all texts and vectors are scanned."""
    r = config.retrieval
    fetch = fusion.fetch_size(k)
    asked = pinned(queries.select("query_id", "qvec", T.normal_query(F.col("q")).alias("q")), vector.MAX_QUERIES)
    near = vector.topk(chunks, asked, fetch) if cells is None else vector.indexed_topk(cells, asked, fetch)
    text = fulltext.two_passes(chunks, asked, fetch, strict=r.strict_fts, rank_order=r.fts_rank_order, stop=list(r.stop_words), technical=list(r.technical_terms), index=index)
    kinds = asked.select("query_id", F.coalesce(T.is_technical(F.col("q"), list(r.technical_terms)), F.lit(False)).alias("technical"))
    return fusion.pool(fusion.fused(near, text, kinds, r.rrf_constant, r.fts_weight, r.fts_tech_weight), r.rerank_pool)


def search(chunks: DataFrame, queries: DataFrame, k: int, config: Config = Config(), reranker: rerank.Reranker | None = None, index: fulltext.Index | None = None, cells: vector.Cells | None = None) -> DataFrame:
    """query_id, rank, id, filename, text, score, rrf: up to k results of each question. chunks has id, text, filename and embedding, each id once."""
    r = config.retrieval
    queries = pinned(queries.select("query_id", "q", "qvec"), vector.MAX_QUERIES)
    found = broadcast_if_small(written(candidates(chunks, queries, k, config, index, cells), "found"))  # a pool for each question
    rows = chunks.select("id", "filename", "text", "embedding").join(found, "id").join(F.broadcast(queries.select("query_id", "q", F.col("qvec").isNotNull().alias("has_vector"))), "query_id")
    scored = rerank.reranked(rows, reranker)
    return mmr.diversified(scored, k, r.max_per_file, r.mmr_lambda).select("query_id", "rank", "id", "filename", "text", "score", "rrf")


class HybridEngine:
    """A store, its settings and the models it works with. Without an embedder questions are answered from full text alone."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), embedder: rerank.Embedder | None = None, reranker: rerank.Reranker | None = None) -> None:
        self.store, self.config, self.embedder, self.reranker = ChunkStore(spark, path), config, embedder, reranker

    def index(self, root: str, clear: bool = False) -> None:
        """Files below root into the store: extracted, cut, capped, without copies, embedded. Files indexed before are left as they are."""
        if clear:
            self.store.clear()
        self.insert(files.file_chunks(files.scanned(self.store.spark, root, self.config.retrieval), self.config.retrieval))

    def insert(self, chunks: DataFrame) -> dict[str, int]:
        """New chunks into the store, embedded once each. Chunks whose embedding failed before are tried again when they come again."""
        rows = chunks.select("id", "text", "filename")
        if self.embedder is None:
            return self.store.insert(rows.withColumn("embedding", F.lit(None).cast("array<float>")))
        return self.store.insert(rows, lambda new: rerank.embedded(new, "text", "embedding", self.embedder))

    def index_vectors(self) -> None:
        """Builds the cells for approximate search anew. It's used if the settings allow it and the store has enough vectors."""
        vector.build_cells(self.store.chunks(), f"{self.store.path}/cells")

    def _cells(self) -> vector.Cells | None:
        r = self.config.retrieval
        if not r.approximate or not self.store._exists("cells/centres"):
            return None
        cells = vector.open_cells(self.store.spark, f"{self.store.path}/cells")
        return cells if cells.vectors.limit(r.ann_threshold).count() >= r.ann_threshold else None

    def questions(self, queries: DataFrame) -> DataFrame:
        """query_id, q, qvec: with the mean of the question's embedding and that of its words without stop words."""
        q = queries.select("query_id", T.normal_query(F.col("q")).alias("q"))
        if self.embedder is None:
            return q.withColumn("qvec", F.lit(None).cast("array<float>"))
        bare = T.without_stop_words(F.col("q"))
        prefix = F.lit(rules.EMBEDDING_PREFIX)
        two = q.withColumn("a", F.concat(prefix, "q")).withColumn("b", F.when((bare != "") & (bare != F.col("q")), F.concat(prefix, bare)))
        both = rerank.embedded(rerank.embedded(two, "a", "va", self.embedder), "b", "vb", self.embedder)
        return both.select("query_id", "q", V.mean(F.col("va"), F.col("vb")).alias("qvec"))

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Results of all questions (query_id, q)."""
        return search(self.store.chunks(), self.questions(queries), k or self.config.retrieval.context_chunks, self.config, self.reranker, self.store.text_index(), self._cells())

    def ask(self, queries: DataFrame, k: int | None = None, chat: bool = True) -> DataFrame:
        """query_id, decision, prompt, context, included, files, max_rrf. The search runs once; prompt is null unless the decision is to answer."""
        found = written(self.search(queries, k), "results")
        cited = context.contexts(context.context_rows(found))
        r = self.config.retrieval
        decided = context.decisions(queries, found, r.min_score, chat, r.word_boundary_small_talk)
        prompt = context.prompts(queries, cited, context.platforms(found))
        joined = decided.join(cited, "query_id", "left").join(prompt, "query_id", "left")
        return joined.select("query_id", "decision", F.when(F.col("decision") == context.ANSWER, F.col("prompt")).alias("prompt"), "context", F.coalesce("included", F.lit(0)).alias("included"), F.coalesce("files", F.lit(0)).alias("files"), "max_rrf")

    def answer(self, queries: DataFrame, generator: rerank.Generator, k: int | None = None, chat: bool = True) -> DataFrame:
        """As ask, with answer and error: the model is asked once for each question that can be answered."""
        return written(rerank.generated(self.ask(queries, k, chat), generator), "answers")

    def stats(self) -> DataFrame:
        return self.store.stats()

    def files(self) -> DataFrame:
        return self.store.files()

    def clear(self) -> None:
        self.store.clear()
