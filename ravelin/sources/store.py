"""A chunk store: Parquet tables in one folder. Spark's commit protocol makes each write whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import fulltext
from ravelin.runtime import written

SCHEMA = "id STRING, text STRING, filename STRING, embedding ARRAY<FLOAT>"
KEPT = ("id", "text", "filename")


class ChunkStore:
    """id, text, filename, embedding (null: not embedded). The size of vectors is that of the first write; other sizes are refused.

    Tables are only appended to: chunks, vectors that came later than their chunk (refills), postings and sums of the full-text index. compact()
    brings them together. A mark lies in the folder while an insert runs; if it's still there, the next one builds the index anew.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._file(name)
        return fs.exists(p)

    def chunks(self) -> DataFrame:
        if not self._exists("chunks"):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/chunks")
        if not self._exists("refills"):
            return rows
        later = self.spark.read.schema("id STRING, embedding ARRAY<FLOAT>").parquet(f"{self.path}/refills").groupBy("id").agg(F.first("embedding").alias("later"))
        return rows.join(later, "id", "left").select(*KEPT, F.coalesce("embedding", "later").alias("embedding"))

    def vec_dim(self) -> int:
        """Size of the stored vectors, 0 if there are none."""
        return self.chunks().agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("n")).first()["n"]

    def insert(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Appends rows whose identifiers aren't there yet, each once, after checking all vectors' sizes; says how many were added, refilled and left without a vector.

        embed gives rows (id, text, filename) their embedding column. It sees each new row once, and rows that are stored without a vector though
        they have a text: a model that failed is asked again. Rows that bring a vector for such a chunk refill it as well.
        """
        new = rows.select(*KEPT, *([] if embed else [F.col("embedding").cast("array<float>").alias("embedding")])).where("id is not null").dropDuplicates(["id"])
        stored = self.chunks()
        there = stored.select("id", F.col("embedding").isNotNull().alias("whole"))
        todo = new.join(there, "id", "left").where("whole is null or not whole").withColumn("known", F.col("whole").isNotNull()).drop("whole")
        if embed:
            # what's known without a text stays without a vector; embed sees the rest exactly once, for what it gives is written before anything else reads it
            asked = written(todo.where("not known or text is not null"), "new")
            todo = embed(asked.drop("known")).select(*KEPT, F.col("embedding").cast("array<float>").alias("embedding")).join(asked.select("id", "known"), "id")
        todo = written(todo.select(*KEPT, "embedding", "known").where("not known or embedding is not null") if not embed else todo.select(*KEPT, "embedding", "known"), "new")
        size = F.size(F.col("embedding"))
        n = todo.agg(F.min(F.when(F.col("embedding").isNotNull(), size)).alias("a"), F.max(F.when(F.col("embedding").isNotNull(), size)).alias("b"), F.count_if(~F.col("known")).alias("added"),
                     F.count_if(F.col("known") & F.col("embedding").isNotNull()).alias("refilled"), F.count_if(F.col("text").isNotNull() & F.col("embedding").isNull()).alias("without")).first()
        known = stored.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("n")).first()["n"] if n["a"] is not None else 0
        if n["a"] is not None and (n["a"] != n["b"] or known not in (0, n["a"])):
            raise ValueError(f"vectors of {n['a']} to {n['b']} numbers; the store has {known or 'none'}")
        if self._exists("_inserting"):
            self.index()
        fs, mark = self._file("_inserting")
        fs.create(mark, True).close()
        if n["added"]:
            fresh = todo.where("not known").select(*KEPT, "embedding")
            fresh.write.mode("append").parquet(f"{self.path}/chunks")
            fulltext.append_index(fresh, f"{self.path}/fulltext")
        if n["refilled"]:
            todo.where("known and embedding is not null").select("id", "embedding").write.mode("append").parquet(f"{self.path}/refills")
        fs.delete(mark, False)
        return {"added": n["added"], "refilled": n["refilled"], "without_vector": n["without"]}

    def text_index(self) -> fulltext.Index | None:
        """The full-text index, or None if there's none or an insert broke off since it was written."""
        if not self._exists("fulltext/postings") or self._exists("_inserting"):
            return None
        return fulltext.open_index(self.spark, f"{self.path}/fulltext")

    def compact(self) -> None:
        """Brings chunks and later vectors, and all runs of the index, together."""
        if self._exists("refills"):
            written(self.chunks(), "chunks").write.mode("overwrite").parquet(f"{self.path}/chunks")
            fs, p = self._file("refills")
            fs.delete(p, True)
        self.index()

    def index(self) -> None:
        """Builds the full-text index anew."""
        fulltext.build_index(self.chunks(), f"{self.path}/fulltext")

    def clear(self) -> None:
        """Empties all tables together."""
        fs, p = self._file("")
        fs.delete(p, True)

    def count(self) -> int:
        return self.chunks().count()

    def files(self) -> DataFrame:
        return files(self.chunks())

    def stats(self) -> DataFrame:
        return stats(self.chunks())


def files(chunks: DataFrame) -> DataFrame:
    """Distinct file names, in order."""
    return chunks.select("filename").distinct().orderBy("filename")


def stats(chunks: DataFrame) -> DataFrame:
    """chunks, with_vector, files, vec_dim: one row."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("with_vector"), F.countDistinct("filename").alias("files"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("vec_dim"))
